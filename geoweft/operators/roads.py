"""Road topology from line features, directed edges with costs, and least-time search for many pairs at once."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoweft.functions import geo
from geoweft.functions import roads as rules
from geoweft.operators import raster, spatial
from geoweft.operators.components import components
from geoweft.operators.elimination import Network
from geoweft.operators.numbering import numbered
from geoweft.tables import materialize, spread


VERSION = ["dataset", "version_no"]


def link_lines(features: DataFrame) -> DataFrame:
    """One row for each part of a feature (feature_id, geom_type, parts, attrs) with mapped attributes, and with dataset and
    version_no where there are any; `ok` says whether it becomes a link. One-way in reverse turns the line round."""
    a = {k: rules.attr(rules.lower_keys(F.col("attrs")), v) for k, v in rules.ROAD_ATTRS.items()}
    way = rules.direction(a["oneway"])
    is_line = F.col("geom_type").isin("LineString", "MultiLineString")
    own = [c for c in VERSION if c in features.columns]
    rows = features.select(*own, "feature_id", F.posexplode_outer(F.when(is_line, F.col("parts"))).alias("part", "line"), way.alias("way"), *[rules.truncated(a[k], rules.WIDTHS[k]).alias(k) for k in ("source_id", "road_class", "road_name")], rules.speed_kph(a["max_speed"]).alias("max_speed_kph"))
    rows = rows.withColumn("geom", F.when(F.col("way") == "REVERSE", F.reverse("line")).otherwise(F.col("line"))).withColumn("oneway", F.col("way") != "BOTH")
    rows = rows.withColumn("length_m", geo.line_length(F.col("geom")))
    return rows.withColumn("ok", geo.valid_line(F.col("line")) & F.coalesce(F.col("length_m") > 0, F.lit(False))).drop("way", "line")


def topology(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes numbered from 0 by their first end, links from 1 in feature order. With dataset and version_no, which
    then are in both results, each version has a network and numbers of its own."""
    own = [c for c in VERSION if c in features.columns]

    def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        """Numbers from 0 within each version: those of all rows less the version's first."""
        out = numbered(rows, [*own, *by], name)
        if not own:
            return out
        out = materialize(out, name)
        first = out.groupBy(*own).agg(F.min(name).alias("__first"))
        return out.join(first, own).withColumn(name, F.col(name) - F.col("__first")).drop("__first")

    lines = in_order(link_lines(features).where("ok").drop("ok"), ["feature_id", "part"], "n").withColumn("link_id", F.col("n") + 1).drop("n")
    first, last = F.element_at("geom", 1), F.element_at("geom", -1)
    ends = lines.select(*own, F.explode(F.array(*[F.struct(F.col("feature_id"), F.col("part"), F.lit(e).alias("end"), p["x"].alias("lon"), p["y"].alias("lat")) for e, p in ((0, first), (1, last))])).alias("e")).select(*own, "e.*")
    ends = ends.withColumn("kx", geo.snapped(F.col("lon"))).withColumn("ky", geo.snapped(F.col("lat")))
    seen = ends.groupBy(*own, "kx", "ky").agg(F.min(F.struct("feature_id", "part", "end", "lon", "lat")).alias("f")).select(*own, "kx", "ky", "f.*")
    nodes = materialize(in_order(seen, ["feature_id", "part", "end"], "node_seq").select(*own, "node_seq", "lon", "lat", "kx", "ky"), "nodes")
    for e, p in (("from_node", first), ("to_node", last)):
        at = nodes.select(*own, F.col("node_seq").alias(e), F.col("kx").alias("__x"), F.col("ky").alias("__y"))
        lines = lines.withColumns({"__x": geo.snapped(p["x"]), "__y": geo.snapped(p["y"])}).join(at, [*own, "__x", "__y"]).drop("__x", "__y")
    links = lines.select(*own, "link_id", "source_id", "from_node", "to_node", "road_class", "road_name", "oneway", "max_speed_kph", "length_m", "geom")
    return nodes.select(*own, "node_seq", "lon", "lat"), materialize(links, "links")


def skipped(features: DataFrame) -> DataFrame:
    return link_lines(features).agg(F.count_if(~F.col("ok")).alias("skipped"))


def dangling(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with an end that is no node."""
    ends = links.select("link_id", F.explode(F.array("from_node", "to_node")).alias("node_seq"))
    return ends.join(nodes, "node_seq", "left_anti")


def connectivity(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """component_count, largest, node_count, ratio; nodes without links are components of their own."""
    found = components(links, "from_node", "to_node")
    of = nodes.join(found, nodes["node_seq"] == found["node"], "left").select("node_seq", F.coalesce("component", "node_seq").alias("component"))
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.count(F.lit(1)).alias("component_count"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"))
    return total.withColumn("ratio", F.when(F.col("node_count") > 0, F.col("largest") / F.col("node_count")).otherwise(0.0))


def measures(features: DataFrame) -> DataFrame:
    """What the rules on road data ask for, by dataset and version_no, from features as link_lines() takes them: features of
    another type, links that can't be made, links without speed or class, extent, components and the share of the largest."""
    line = F.coalesce(F.col("geom_type").isin("LineString", "MultiLineString"), F.lit(False))
    base = features.groupBy(*VERSION).agg(F.lit("ROAD_NETWORK").alias("type"), F.count(F.lit(1)).alias("n_features"), F.count_if(~line).alias("n_mismatched"))
    node = lambda p: F.xxhash64(*VERSION, geo.snapped(p["x"]), geo.snapped(p["y"]))
    first, last = F.element_at("geom", 1), F.element_at("geom", -1)
    sides = [f(F.col(f"geom.{c}")).alias(n + c) for n, f in (("min", F.array_min), ("max", F.array_max)) for c in ("x", "y")]
    slow, plain = F.col("max_speed_kph").isNull().alias("slow"), (F.coalesce(F.trim("road_class"), F.lit("")) == "").alias("plain")
    # lines cost most of the time and are asked for several times, so what is asked for is written once
    lines = materialize(link_lines(spread(features)).where("geom is not null").select(*VERSION, "feature_id", "ok", slow, plain, *sides, node(first).alias("a"), node(last).alias("b"), first["x"].alias("x"), first["y"].alias("y")), "lines")
    made = lines.where("ok").groupBy(*VERSION).agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if("slow").alias("n_no_speed"), F.count_if("plain").alias("n_no_class"), *[f(n + c).alias(n + c) for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")]
    )
    invalid = lines.where("not ok").groupBy(*VERSION).agg(F.countDistinct("feature_id").alias("n_invalid"))
    ends = lines.where("ok")
    of = ends.select(*VERSION, F.explode(F.array("a", "b")).alias("node")).distinct().join(components(ends, near=[*VERSION, "y", "x"]), "node")
    sizes = of.groupBy(*VERSION, "component").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("n_components"), (F.max("n") / F.sum("n")).alias("largest_ratio"))
    out = base.join(made, VERSION, "left").join(invalid, VERSION, "left").join(whole, VERSION, "left")
    return out.fillna(0, ["n_links", "n_invalid", "n_no_speed", "n_no_class", "n_components"])


def component_sizes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node_seq, component, size: of nodes without links too."""
    found = components(links, "from_node", "to_node")
    of = nodes.join(found, nodes["node_seq"] == found["node"], "left").select("node_seq", F.coalesce("component", "node_seq").alias("component"))
    return of.join(of.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node_seq", "component", "size")


def edge_offsets(edges_: DataFrame) -> DataFrame:
    """src, offset, degree: where a node's edges begin when all are in order of (src, edge_id), for nodes that have any."""
    return numbered(edges_.select("src", "edge_id"), ["src", "edge_id"], "n").groupBy("src").agg(F.min("n").alias("offset"), F.count(F.lit(1)).alias("degree"))


def node_elevation(nodes: DataFrame, tiles: DataFrame, meta: DataFrame, dataset: str, size: int = 512) -> DataFrame:
    """node_seq, z: bilinear elevation of each node in an elevation model, null outside and on NoData."""
    at = nodes.select(F.col("node_seq").alias("qid"), F.lit(dataset).alias("dataset"), "lon", "lat")
    return raster.bilinear(at, tiles, meta, size).select(F.col("qid").alias("node_seq"), F.col("elevation").alias("z"))


def edges(links: DataFrame, elevation: DataFrame | None = None) -> DataFrame:
    """Two directed edges a link: edge_id, link_id, src, dst, forward, car, length_m, road_class, max_speed_kph, slope.
    elevation: node_seq, z (null where unknown)."""
    allowed = rules.car_allowed(F.col("road_class"))
    ways = F.array(
        F.struct((F.col("link_id") * 2).alias("edge_id"), F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.lit(True).alias("forward"), allowed.alias("car")),
        F.struct((F.col("link_id") * 2 + 1).alias("edge_id"), F.col("to_node").alias("src"), F.col("from_node").alias("dst"), F.lit(False).alias("forward"), (allowed & ~F.col("oneway")).alias("car")),
    )
    e = links.select("link_id", "length_m", "road_class", "max_speed_kph", F.explode(ways).alias("w")).select("w.*", "link_id", "length_m", "road_class", "max_speed_kph")
    if elevation is None:
        return e.withColumn("z_src", F.lit(None).cast("double")).withColumn("z_dst", F.lit(None).cast("double")).withColumn("slope", F.lit(0.0))
    for end in ("src", "dst"):
        e = e.join(elevation.select(F.col("node_seq").alias(end), F.col("z").alias(f"z_{end}")), end, "left")
    return e.withColumn("slope", geo.slope(F.col("z_src"), F.col("z_dst"), F.col("length_m")))


def costs(edges_: DataFrame) -> DataFrame:
    """mode, edge_id, src, dst, cost for every mode that may pass."""
    c = [F.struct(F.lit(m).alias("mode"), rules.edge_cost(m, F.col("length_m"), F.col("road_class"), F.col("max_speed_kph"), F.col("slope"), F.col("car")).alias("cost")) for m in ("CAR", "WALK", "BIKE")]
    return edges_.select("edge_id", "src", "dst", F.explode(F.array(*c)).alias("m")).select("m.mode", "edge_id", "src", "dst", "m.cost").where("cost is not null")


def max_speed_mps(edges_: DataFrame) -> DataFrame:
    """mode, vmax: what the straight-line bound divides by."""
    car = edges_.agg(F.greatest(F.lit(1.0), F.coalesce(F.max(F.when(F.col("car"), rules.car_speed_kph(F.col("road_class"), F.col("max_speed_kph")))), F.lit(1)).cast("double")).alias("kph"))
    rows = F.array(F.struct(F.lit("CAR").alias("mode"), F.col("kph").alias("v")), F.struct(F.lit("WALK").alias("mode"), F.lit(rules.WALK_MAX_KPH).alias("v")), F.struct(F.lit("BIKE").alias("mode"), F.lit(rules.BIKE_MAX_KPH).alias("v")))
    return car.select(F.explode(rows).alias("r")).select("r.mode", (F.col("r.v") / 3.6).alias("vmax"))


#: Nodes of a cell: a range of node numbers, the unit that one step of a search works through at once.
CELL = 32_768
_TREE = "src long, mode string, cell long, g array<double>, edge_id array<long>, pred array<long>"


def _cell(node: str):
    return F.floor(F.col(node) / CELL)


def _settle(best: list[float], via: list[int], ways: list[list[tuple[int, float, int]]], heap: list[tuple[float, int]], bound: float, wanted: set[int] | None) -> None:
    """Dijkstra's method from the nodes in heap, whose cheaper ways are in best already; via gets the edge's place. With `wanted`,
    all the targets of a tree, it ends once they are settled, and what isn't by then is open again."""
    heapq.heapify(heap)
    left = None if wanted is None else {n for n in wanted if n < len(best)}
    if wanted is not None and len(left) < len(wanted):
        left = None  # a target that no edge meets is never reached
    while heap:
        g, node = heapq.heappop(heap)
        if g > best[node]:
            continue
        for to, cost, k in ways[node]:
            way = g + cost
            if way < best[to] and way <= bound:
                best[to], via[to] = way, k
                heapq.heappush(heap, (way, to))
        if left is not None:
            left.discard(node)
            if not left:
                bound, left = min(bound, g + 1e-6), None
        if g > bound:
            break
    inf = float("inf")
    for g, node in heap:
        if g > bound and g == best[node]:
            best[node] = inf


def _entered(edges: pa.Table) -> pa.Table:
    """The nodes of a cell to which a way leads from one of its edges that come from other cells."""
    src, dst, inner = (edges.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "inner"))
    ways: dict[int, list[int]] = {}
    for a, b in zip(src[inner].tolist(), dst[inner].tolist()):
        ways.setdefault(a, []).append(b)
    seen = set(dst[~inner].tolist())
    left = list(seen)
    while left:
        for node in ways.get(left.pop(), ()):
            if node not in seen:
                seen.add(node)
                left.append(node)
    return pa.table({"mode": pa.array(edges.column("mode").slice(0, 1).to_pylist() * len(seen), pa.string()), "dst": pa.array(sorted(seen), pa.int64())})


def _relaxed(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """Settles one cell for many sources: messages (cheaper ways into the cell) go along the cell's edges until nothing gets
    cheaper; edges that leave it make the messages of the next round. Lists end with the last node of the cell that an edge or a message meets."""
    n, none = rows.num_rows, np.int64(-1)
    e = {k: edges.column(k).to_numpy() for k in ("edge_id", "src", "dst", "cost", "dlon", "dlat")}
    inner = edges.column("inner").to_numpy().astype(bool)
    told = rows.column("told").combine_chunks()
    row = np.repeat(np.arange(n), told.value_lengths().to_numpy())
    node, g, edge, frm = (told.flatten().field(k).to_numpy() for k in ("node", "g", "edge_id", "pred"))
    olds = [rows.column(c).combine_chunks() for c in ("g", "edge_id", "pred")]
    had = np.flatnonzero(olds[0].is_valid().to_numpy(zero_copy_only=False))
    size = 1 + max(*(int(x.max()) if len(x) else 0 for x in (node % CELL, e["src"] % CELL, e["dst"][inner] % CELL)), *(len(olds[0][int(k)].values) - 1 for k in had), 0)
    best, via, pred = np.full((n, size), np.inf), np.full((n, size), none), np.full((n, size), none)
    for k in had:
        for out, old in zip((best, via, pred), olds):
            held = old[int(k)].values.to_numpy(zero_copy_only=False)
            out[k, : len(held)] = held
    bound = np.nan_to_num(rows.column("bound").to_numpy().astype(np.float64), nan=np.inf) + 1e-6
    wants, inside, asked = (rows.column(c).to_pylist() for c in ("wants", "inside", "n_asked"))
    ok = g < best[row, node % CELL]
    row, at = row[ok], node[ok] % CELL
    best[row, at], via[row, at], pred[row, at] = g[ok], edge[ok], frm[ok]
    moved = np.zeros((n, size), bool)
    moved[row, at] = True
    order = np.flatnonzero(inner)[np.lexsort((e["edge_id"][inner], e["src"][inner]))]
    ways = [[] for _ in range(size)]
    for src, dst, cost, k in zip((e["src"][order] % CELL).tolist(), (e["dst"][order] % CELL).tolist(), e["cost"][order].tolist(), order.tolist()):
        ways[src].append((dst, cost, k))
    for k in range(n):
        mine, by = best[k].tolist(), [-1] * size
        start = at[row == k].tolist()
        # all targets of the tree that ways over other cells lead to are here, so that the dearest of them ends the work
        here = {d % CELL for d in wants[k] or ()} if len(wants[k] or ()) == asked[k] else None
        wanted = None if here is None else here | {d % CELL for d in inside[k] or ()} or None
        _settle(mine, by, ways, [(mine[i], i) for i in start], float(bound[k]), wanted)
        best[k], taken = mine, np.array(by)
        if here is not None:  # and none of its ways that leave may be dearer
            bound[k] = min(bound[k], max((mine[d] if d < size else np.inf for d in here), default=-np.inf) + 1e-6)
        new = np.flatnonzero(taken >= 0)
        via[k, new], pred[k, new], moved[k, new] = e["edge_id"][taken[new]], e["src"][taken[new]], True
    closed = best < np.inf
    via[~closed], pred[~closed] = none, none
    moved &= closed
    out = np.flatnonzero(~inner)
    i, j = np.nonzero(moved[:, e["src"][out] % CELL])
    way, leave = best[i, e["src"][out[j]] % CELL] + e["cost"][out[j]], out[j]
    if "tlon" in rows.column_names:  # with the straight line to the nearest target at top speed, which is never too much
        far = np.full(len(i), np.inf)
        lists = [rows.column(c).to_pylist() for c in ("tlon", "tlat", "vmax")]
        for s in np.unique(i):
            here = i == s
            x, y, v = (lists[k][s] for k in range(3))
            if not x or v is None or None in x:
                far[here] = 0.0
                continue
            lon, lat = np.radians(e["dlon"][leave[here]]), np.radians(e["dlat"][leave[here]])
            for tx, ty in zip(np.radians(x), np.radians(y)):
                h = np.sin((ty - lat) / 2) ** 2 + np.cos(lat) * np.cos(ty) * np.sin((tx - lon) / 2) ** 2
                far[here] = np.fmin(far[here], 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1))) / v)
        ok = way + np.nan_to_num(far) <= bound[i]
    else:
        ok = way <= bound[i]
    i, way, leave = i[ok], way[ok], leave[ok]
    tell = pa.StructArray.from_arrays([pa.array(e["dst"][leave]), pa.array(way), pa.array(e["edge_id"][leave]), pa.array(e["src"][leave])], ["node", "g", "edge_id", "pred"])
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(i, minlength=n))).astype(np.int32))
    fixed = pa.array(np.arange(0, n * size + 1, size, dtype=np.int32))
    lists = [pa.ListArray.from_arrays(fixed, pa.array(x.reshape(-1))) for x in (best, via, pred)]
    return pa.Table.from_arrays([*(rows.column(c) for c in ("src", "mode", "cell")), *lists, pa.ListArray.from_arrays(offsets, tell)], ["src", "mode", "cell", "g", "edge_id", "pred", "tell"])


def search(od: DataFrame, cost: DataFrame, nodes: DataFrame | None = None, vmax: DataFrame | None = None, max_rounds: int = 10_000, per_task: int = 64) -> DataFrame:
    """Least-time trees of od (od_id, src, dst, mode): a row for each source, mode and cell of CELL node numbers, with the
    cell's nodes in order, perhaps without the last ones: g (infinite where not reached), edge_id and pred (-1 at the source and where not reached).

    Pairs that share source and mode share a tree. A round settles every cell that got a cheaper way in, for up to about
    `per_task` sources a task, so there are as many rounds as cells on a way, not edges. Once all targets of a tree are
    reached, nothing dearer than the dearest of them is carried on; with nodes and vmax neither is what the straight line at top
    speed makes dearer. A target to which no way leads from outside its cell keeps no search going beyond that cell, whether
    it can be reached or not. dst may be null (one to all); pairs without src have no tree. Each round is written to the shared folder."""
    tree = ["src", "mode"]
    asked = od.where("src is not null").select("src", "mode", "dst").distinct()
    into = cost.select("mode", _cell("dst").alias("cell"), "src", "dst", (_cell("src") == _cell("dst")).alias("inner"))
    entered = into.groupBy("mode", "cell").applyInArrow(_entered, "mode string, dst long").withColumn("far", F.lit(True))
    asked = asked.join(entered, ["mode", "dst"], "left").withColumn("far", F.col("dst").isNull() | F.col("far").isNotNull())
    asked = materialize(asked.select("src", "mode", "dst", "far"), "asked")
    targets = asked.withColumn("cell", _cell("dst"))
    known = asked.groupBy(*tree).agg(F.bool_or(F.col("dst").isNull()).alias("all"), F.count_if("far").alias("n_asked"))
    lists = [F.collect_list(F.when(c, F.col("dst"))).alias(n) for n, c in (("wants", F.col("far")), ("inside", ~F.col("far")))]
    wants = materialize(targets.where("dst is not null").groupBy(*tree, "cell").agg(*lists), "wants")  # at most CELL of them
    place = (nodes if nodes is not None else asked.select(F.col("src").alias("node_seq"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat")).limit(0)).select("node_seq", "lon", "lat")
    if nodes is not None:
        there = asked.where("far").join(place.withColumnRenamed("node_seq", "dst"), "dst", "left").groupBy(*tree).agg(F.collect_list("lon").alias("tlon"), F.collect_list("lat").alias("tlat"), F.count_if(F.col("lon").isNull()).alias("lost"))
        known = known.join(there, tree, "left").join(vmax, "mode", "left").withColumn("vmax", F.when(~F.col("all") & (F.col("lost") == 0), F.col("vmax"))).drop("lost")
    known = materialize(known, "trees")
    salts = max(1, -(-(known.groupBy("mode").count().agg(F.max("count")).first()[0] or 0) // per_task))
    sc = asked.sparkSession.sparkContext
    tasks = max(2 * sc.defaultParallelism, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a fixed number, as few bytes stand for much work
    salt = F.pmod(F.xxhash64("src"), F.lit(salts))
    edges_ = cost.join(place.select(F.col("node_seq").alias("dst"), F.col("lon").alias("dlon"), F.col("lat").alias("dlat")), "dst", "left")
    edges_ = materialize(edges_.select("mode", _cell("src").alias("cell"), "edge_id", "src", "dst", "cost", "dlon", "dlat", (_cell("src") == _cell("dst")).alias("inner")), "edges")
    tell = F.struct(F.col("src").alias("node"), F.lit(0.0).alias("g"), F.lit(-1).cast("long").alias("edge_id"), F.lit(-1).cast("long").alias("pred"))
    told = known.select(*tree, _cell("src").alias("cell"), F.array(tell).alias("told"))
    state, reached, new, bound = None, None, None, None
    for _ in range(max_rounds):
        rows = told.join(known, tree).join(wants, [*tree, "cell"], "left")
        if state is None:
            rows = rows.withColumns({"g": F.lit(None).cast("array<double>"), "edge_id": F.lit(None).cast("array<long>"), "pred": F.lit(None).cast("array<long>"), "bound": F.lit(None).cast("double")})
        else:
            rows = rows.join(state, [*tree, "cell"], "left").join(bound, tree, "left")
        rows = rows.withColumn("salt", salt)
        lanes = edges_.join(rows.select("mode", "cell", F.col("salt").alias("lane")).distinct(), ["mode", "cell"])
        settled = rows.repartition(tasks, "mode", "cell", "salt").groupBy("mode", "cell", "salt").cogroup(lanes.repartition(tasks, "mode", "cell", "lane").groupBy("mode", "cell", "lane")).applyInArrow(_relaxed, f"{_TREE}, tell array<struct<node: long, g: double, edge_id: long, pred: long>>")
        new = materialize(settled, "settled", replaces=new)
        trees = new.drop("tell")
        if state is None and not new.where(F.size("tell") > 0).limit(1).count():
            return trees  # each within one cell
        found = targets.join(new.select(*tree, "cell", "g"), [*tree, "cell"]).select(*tree, "dst", F.get("g", F.pmod("dst", F.lit(CELL)).cast("int")).alias("g"))
        reached = materialize((found if reached is None else reached.unionByName(found)).groupBy(*tree, "dst").agg(F.min("g").alias("g")), "reached", replaces=reached)
        bound = asked.where("far").join(reached, [*tree, "dst"], "left").groupBy(*tree).agg(F.when(F.bool_and(F.coalesce(F.col("g") < float("inf"), F.lit(False))), F.max("g")).alias("bound")).where("bound is not null")
        bound = materialize(asked.groupBy(*tree).agg(F.count_if(F.col("dst").isNull()).alias("open")).where("open = 0").join(bound, tree).drop("open"), "bound")  # small, and the next round's plan still names the last one
        state = materialize(trees if state is None else state.join(trees.select(*tree, "cell"), [*tree, "cell"], "left_anti").unionByName(trees), "trees", replaces=state)
        ways = new.select(*tree, F.explode("tell").alias("t")).groupBy(*tree, F.col("t.node").alias("node")).agg(F.min(F.struct("t.g", "t.edge_id", "t.pred")).alias("w"))
        ways = ways.withColumn("cell", _cell("node")).join(bound, tree, "left").where("bound is null or w.g <= bound + 1e-6")
        told = materialize(ways.groupBy(*tree, "cell").agg(F.collect_list(F.struct("node", "w.g", "w.edge_id", "w.pred")).alias("told")), "told", replaces=told)
        if not told.limit(1).count():
            return state
    raise RuntimeError(f"search not settled in {max_rounds} rounds")


#: Sources of a task from which a network's order of elimination pays.
FEW = 50


def _closed(cost: DataFrame) -> bool:
    """Whether no edge leaves its cell, so that each cell is a network of its own and no tree has to be kept between rounds."""
    return not cost.where(_cell("src") != _cell("dst")).limit(1).count()


def _answered(answer: Callable[..., pa.Table], at_once: int = 256) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogrouped sources (with `wants`) and edges of one closed cell: answer(rows, best, cell), with the least costs from up to
    `at_once` sources to the cell's nodes at a time."""

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        cell = {c: edges.column(c).to_numpy(zero_copy_only=False) for c in edges.column_names if c not in ("mode", "lane")}
        src, wants = rows.column("src").to_numpy() % CELL, rows.column("wants").combine_chunks().flatten().to_numpy()
        cell["src"], cell["dst"] = cell["src"] % CELL, cell["dst"] % CELL
        n = 1 + max(int(x.max()) if len(x) else 0 for x in (src, wants % CELL, cell["src"], cell["dst"]))
        net = Network.of(n, cell["src"], cell["dst"], cell["cost"]) if len(src) >= FEW else None
        if net is None:
            ways: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
            for a, b, c in zip(cell["src"].tolist(), cell["dst"].tolist(), cell["cost"].tolist()):
                ways[a].append((b, c, 0))
        parts = []
        for first in range(0, len(src), at_once):
            some = src[first : first + at_once]
            if net is not None:
                best = net.costs(some)
            else:
                best = np.full((len(some), n), np.inf)
                for k, node in enumerate(some.tolist()):
                    one = [np.inf] * n
                    one[node] = 0.0
                    _settle(one, [0] * n, ways, [(0.0, node)], np.inf, None)
                    best[k] = one
            parts.append(answer(rows.slice(first, at_once), best, cell))
        return pa.concat_tables(parts)

    return run


def _wanted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each target of rows, the row's place and the target."""
    wants = rows.column("wants").combine_chunks()
    return np.repeat(np.arange(rows.num_rows), wants.value_lengths().to_numpy()), wants.flatten().to_numpy()


def _keyed(rows: pa.Table, k: np.ndarray, dst: np.ndarray, **more: pa.Array) -> pa.Table:
    """A row (src, mode, dst, ...) for each k, the place of its source in rows."""
    return pa.table({"src": rows.column("src").combine_chunks().take(pa.array(k)), "mode": rows.column("mode").combine_chunks().take(pa.array(k)), "dst": pa.array(dst, pa.int64()), **more})


def _at_once(od: DataFrame, cost: DataFrame, answer: Callable[..., pa.Table], schema: str, sources: int = 2_000, targets: int = 500_000, nodes: DataFrame | None = None, vmax: DataFrame | None = None) -> DataFrame:
    """answer() for the pairs of od in a network that is _closed(), in one pass: a task takes up to about so many `sources` of a cell with so many
    `targets`, and what it returns is all that leaves it. Pairs of the same source, mode and target count once. With nodes
    edges have the radians of their ends (sx, sy, dx, dy), with vmax rows have it."""
    spark = od.sparkSession
    asked = od.where("src is not null").withColumn("__dst", F.when(_cell("src") == _cell("dst"), F.col("dst")))  # other cells aren't reached
    asked = materialize(asked.groupBy("src", "mode").agg(F.collect_set("__dst").alias("wants")).withColumn("cell", _cell("src")), "asked")
    sizes = asked.groupBy("mode", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("wants")).alias("m")).agg(F.count(F.lit(1)), F.max("n"), F.max("m")).first()
    keys, n, m = (x or 0 for x in sizes)
    par = spark.sparkContext.defaultParallelism
    salts = max(1, min(-(-n // FEW), -(-3 * par // max(1, 2 * keys))), -(-n // sources), -(-m // targets))
    tasks = max(2 * par, min(4 * keys * salts, 1000))  # more than groups, so that few share one
    rows = asked.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(salts)))
    rows = rows if vmax is None else rows.join(vmax, "mode", "left")
    edges_ = cost.select("mode", _cell("src").alias("cell"), "edge_id", "src", "dst", "cost")
    for end in ("src", "dst") if nodes is not None else ():
        edges_ = edges_.join(nodes.select(F.col("node_seq").alias(end), F.radians("lon").alias(f"{end[0]}x"), F.radians("lat").alias(f"{end[0]}y")), end, "left")
    lanes = edges_.join(rows.select("mode", "cell", F.col("salt").alias("lane")).distinct(), ["mode", "cell"])
    at, beside = ["mode", "cell", "salt"], ["mode", "cell", "lane"]
    return rows.repartition(tasks, *at).groupBy(*at).cogroup(lanes.repartition(tasks, *beside).groupBy(*beside)).applyInArrow(_answered(answer), schema)


_PAIR = ["src", "mode", "dst"]


def _times_of(rows: pa.Table, best: np.ndarray, cell: dict[str, np.ndarray]) -> pa.Table:
    k, dst = _wanted(rows)
    g = best[k, dst % CELL]
    ok = g < np.inf
    return _keyed(rows, k[ok], dst[ok], g=pa.array(g[ok]))


def times(od: DataFrame, cost: DataFrame, nodes: DataFrame | None = None, vmax: DataFrame | None = None) -> DataFrame:
    """od_id, g of the pairs whose target can be reached. In a network of closed cells no tree is written."""
    if not _closed(cost):
        return reached(od, search(od, cost, nodes, vmax))
    return od.join(_at_once(od, cost, _times_of, "src long, mode string, dst long, g double"), _PAIR).select("od_id", "g")


def _trees_of(rows: pa.Table, best: np.ndarray, cell: dict[str, np.ndarray]) -> pa.Table:
    k, node = np.nonzero(best < np.inf)
    first = rows.column("src").to_numpy() // CELL * CELL
    return _keyed(rows, k, first[k] + node, g=pa.array(best[k, node])).rename_columns(["src", "mode", "node", "g"])


def one_to_all(od: DataFrame, cost: DataFrame) -> DataFrame:
    """src, mode, node, g of every node that can be reached from a source of od. In a network of closed cells no tree is written."""
    od = od.select("src", "mode").distinct().withColumns({"dst": F.lit(None).cast("long"), "od_id": F.lit(None).cast("long")})
    if not _closed(cost):
        return labels(search(od, cost)).select("src", "mode", "node", "g")
    return _at_once(od, cost, _trees_of, "src long, mode string, node long, g double", sources=256)


def _settled_of(rows: pa.Table, best: np.ndarray, cell: dict[str, np.ndarray]) -> pa.Table:
    """What settled() counts, from whole trees."""
    n = best.shape[1]
    lon, lat = np.full(n, np.nan), np.full(n, np.nan)
    for end in ("src", "dst"):
        lon[cell[end]], lat[cell[end]] = cell[f"{end[0]}x"], cell[f"{end[0]}y"]
    spots = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])  # a square of half the straight line between two is that of the angle's sine
    k, dst = _wanted(rows)
    vmax, goal = rows.column("vmax").to_numpy(), best[k, dst % CELL]
    ok = (goal < np.inf) & ~np.isnan(vmax[k])
    k, dst, goal = k[ok], dst[ok], goal[ok]
    a, b = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    ends = np.append(np.flatnonzero(np.diff(k, prepend=-1)), len(k))
    for first, last in zip(ends[:-1], ends[1:]):
        g, v = best[k[first]], vmax[k[first]] / (2 * geo.EARTH_RADIUS_M)
        there = np.flatnonzero((g < goal[first:last].max()) & ~np.isnan(lon))
        there = there[np.argsort(g[there])]
        g, (x, y, z) = g[there], spots[:, there]
        for i in range(first, last):
            m, (tx, ty, tz) = np.searchsorted(g, goal[i] - 1e-6), spots[:, dst[i] % CELL]
            h = (x[:m] - tx) ** 2 + (y[:m] - ty) ** 2 + (z[:m] - tz) ** 2
            a[i], b[i] = m, np.count_nonzero(h < 4 * np.sin(np.minimum((goal[i] - 1e-6 - g[:m]) * v, np.pi / 2)) ** 2)
    return _keyed(rows, k, dst, g=pa.array(goal), nodes_a=pa.array(a + 1), nodes_b=pa.array(b + 1))


def _ways_of(rows: pa.Table, best: np.ndarray, cell: dict[str, np.ndarray], pairs: int = 20_000) -> pa.Table:
    """The edges of each way, the last one first: of those into a node, the one by which its cost comes about."""
    order = np.lexsort((cell["edge_id"], cell["dst"]))
    frm, cost, edge = (cell[c][order] for c in ("src", "cost", "edge_id"))
    into = np.searchsorted(cell["dst"][order], np.arange(best.shape[1] + 1))
    k, dst = _wanted(rows)
    ok = best[k, dst % CELL] < np.inf
    k, dst, src = k[ok], dst[ok], rows.column("src").to_numpy() % CELL
    steps = []
    for begin in range(0, len(k), pairs):
        tree, node = k[begin : begin + pairs], dst[begin : begin + pairs] % CELL
        who, which, left = [], [], np.flatnonzero(node != src[tree])
        total = len(tree)
        for _ in range(best.shape[1]):
            if not len(left):
                break
            t, at = tree[left], node[left]
            least, taken = np.full(len(left), np.inf), np.full(len(left), -1)
            for slot in range(int((into[at + 1] - into[at]).max())):
                e = np.minimum(into[at] + slot, len(edge) - 1)
                way = np.where(into[at] + slot < into[at + 1], best[t, frm[e]] + cost[e], np.inf)
                taken, least = np.where(way < least, e, taken), np.minimum(way, least)
            who.append(left), which.append(edge[taken])
            node[left] = frm[taken]
            left = left[node[left] != src[t]]
        if len(left):
            raise RuntimeError("a way that doesn't lead back to its source")
        who, which = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (who, which))
        offsets = np.append(0, np.cumsum(np.bincount(who, minlength=total)))
        steps.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(which[np.argsort(who, kind="stable")])))
    return _keyed(rows, k, dst, g=pa.array(best[k, dst % CELL]), steps=pa.chunked_array(steps, pa.list_(pa.int64())))


def ways(od: DataFrame, cost: DataFrame, nodes: DataFrame | None = None, vmax: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(goal, steps) of pairs: od_id, g of those whose target can be reached, and what paths() gives. In a network of closed cells
    both come from one pass, and pairs of the same source, mode and target are walked once."""
    if not _closed(cost) or cost.where("not cost > 1e-6").limit(1).count():  # a way that costs nothing can't be told from its cost
        trees = search(od, cost, nodes, vmax)
        return reached(od, trees), materialize(paths(od, trees), "steps")
    found = materialize(_at_once(od, cost, _ways_of, "src long, mode string, dst long, g double, steps array<long>", targets=50_000), "ways")
    both = od.select("od_id", *_PAIR).join(found, _PAIR)
    # dealt by pair before its edges are rows of their own
    return both.select("od_id", "g"), both.select("od_id", "steps").repartition("od_id").select("od_id", F.posexplode("steps").alias("back", "edge_id")).withColumn("back", F.col("back").cast("long"))


def labels(trees: DataFrame) -> DataFrame:
    """src, mode, node, g, edge_id, pred of every node that search() reached; edge_id and pred are null at the source."""
    each = trees.select("src", "mode", (F.col("cell") * CELL).alias("first"), F.posexplode(F.arrays_zip("g", "edge_id", "pred")).alias("i", "l")).where(F.col("l.g") < float("inf"))
    return each.select("src", "mode", (F.col("first") + F.col("i")).alias("node"), "l.g", F.nullif("l.edge_id", F.lit(-1)).alias("edge_id"), F.nullif("l.pred", F.lit(-1)).alias("pred"))


def reached(od: DataFrame, trees: DataFrame) -> DataFrame:
    """od_id, g of the pairs whose target can be reached."""
    at = od.select("od_id", "src", "mode", "dst", _cell("dst").alias("cell")).join(trees.select("src", "mode", "cell", "g"), ["src", "mode", "cell"])
    return at.select("od_id", F.get("g", F.pmod("dst", F.lit(CELL)).cast("int")).alias("g")).where(F.col("g") < float("inf"))


def visited(trees: DataFrame) -> DataFrame:
    """Nodes that the tree of each source and mode holds."""
    return trees.groupBy("src", "mode").agg(F.sum(F.size(F.filter("g", lambda g: g < float("inf")))).alias("visited"))


def paths(od: DataFrame, trees: DataFrame, max_rounds: int = 10_000, per_lane: int = 4096) -> DataFrame:
    """od_id, back (0 for the last edge), edge_id: the tree edges walked back from the target, one cell a round. Pairs that are in
    one cell of one tree walk together, about `per_lane` of them beside each copy of the cell."""
    at_once = ["src", "mode", "cell"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # what is walked over one cell of one tree leaves before the next
                ids, offsets, edges_, backs, nodes_ = [], [0], [], [], []
                via, pred = (b.column(c)[k].values.to_numpy() for c in ("edge_id", "pred"))
                cell, pairs = b.column("cell")[k].as_py(), b.column("pairs")[k].values
                for od_id, node, back in zip(*(pairs.field(c).to_pylist() for c in ("od_id", "node", "back"))):
                    while node // CELL == cell and (edge := via[node % CELL]) >= 0:
                        edges_.append(edge)
                        node = int(pred[node % CELL])
                    ids.append(od_id), backs.append(back), offsets.append(len(edges_)), nodes_.append(node if node // CELL != cell else None)
                steps = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(edges_, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), steps, pa.array(backs, pa.int64()), pa.array(nodes_, pa.int64())], ["od_id", "steps", "back", "node"])

    found = reached(od, trees).select("od_id")
    now = od.join(found, "od_id", "left_semi").select("od_id", "src", "mode", F.col("dst").alias("node"), F.lit(0).cast("long").alias("back"))
    out = None
    for _ in range(max_rounds):
        now = now.withColumn("cell", _cell("node"))
        lanes = now.groupBy(*at_once).agg(F.ceil(F.count(F.lit(1)) / per_lane).alias("lanes"))
        together = now.join(lanes, at_once).groupBy(*at_once, F.pmod(F.xxhash64("od_id"), "lanes").alias("lane")).agg(F.collect_list(F.struct("od_id", "node", "back")).alias("pairs"))
        at = together.join(trees, at_once).select("cell", "pairs", "edge_id", "pred")
        walked = materialize(at.mapInArrow(walk, "od_id long, steps array<long>, back long, node long"), "steps")
        part = walked.select("od_id", "back", F.posexplode("steps").alias("i", "edge_id")).select("od_id", (F.col("back") + F.col("i")).alias("back"), "edge_id")
        out = part if out is None else out.unionByName(part)
        now = walked.where("node is not null").select("od_id", "node", (F.col("back") + F.size("steps")).alias("back")).join(od.select("od_id", "src", "mode"), "od_id")
        if not walked.where("node is not null").limit(1).count():
            return out
    raise RuntimeError(f"paths not walked in {max_rounds} rounds")


def settled(od: DataFrame, trees: DataFrame, nodes: DataFrame, vmax: DataFrame, per_lane: int = 256) -> DataFrame:
    """od_id, nodes_a, nodes_b: how many nodes a plain and a goal-directed search settle until the target of a pair that can be
    reached is settled, itself included.

    Both follow from the tree of a plain search. It settles nodes in order of g, so those with g below the target's; the goal-directed
    one in order of g plus what the straight line to the target takes at top speed, which never falls along a way, so those whose
    sum is below the target's g. Nodes within a microsecond of it count as settled after it. A cell of a tree meets its pairs in lanes of about
    `per_lane`, so a source of any number of pairs is many tasks."""
    place = nodes.select("node_seq", F.radians("lon").alias("x"), F.radians("lat").alias("y"))
    cells = place.withColumn("cell", _cell("node_seq")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(F.pmod("node_seq", F.lit(CELL)).cast("int").alias("at"), "x", "y"))).alias("places"))
    goal = reached(od, trees).join(od.select("od_id", "src", "mode", "dst"), "od_id").join(place.withColumnRenamed("node_seq", "dst"), "dst").join(vmax, "mode")
    lanes = goal.groupBy("src", "mode").agg(F.ceil(F.count(F.lit(1)) / per_lane).alias("lanes"))
    pairs = goal.join(lanes, ["src", "mode"]).groupBy("src", "mode", "vmax", F.pmod(F.xxhash64("od_id"), "lanes").alias("lane")).agg(F.collect_list(F.struct("od_id", "g", "x", "y")).alias("pairs"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, a, c = [], [], []
            for k in range(b.num_rows):
                spots, asked, v = b.column("places")[k].values, b.column("pairs")[k].values, b.column("vmax")[k].as_py()
                at, x, y = (spots.field(n).to_numpy() for n in ("at", "x", "y"))
                g = b.column("g")[k].values.to_numpy()
                there = at < len(g)
                at, x, y = at[there], x[there], y[there]
                g = g[at]
                order = np.argsort(g)
                g, x, y = g[order], x[order], y[order]
                od_id, goal_g, u, w = (asked.field(n).to_numpy() for n in ("od_id", "g", "x", "y"))
                before = np.searchsorted(g, goal_g - 1e-6)  # only nodes that are nearer than the target count in either
                ways = []
                for n, goal, tx, ty in zip(before, goal_g, u, w):
                    h = np.sin((ty - y[:n]) / 2) ** 2 + np.cos(y[:n]) * np.cos(ty) * np.sin((tx - x[:n]) / 2) ** 2
                    ways.append((g[:n] + 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1))) / v < goal - 1e-6).sum())
                ids.append(od_id), a.append(before), c.append(np.array(ways, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else np.zeros(0, np.int64), pa.int64()) for z in (ids, a, c)], ["od_id", "a", "b"])

    met = pairs.join(trees.select("src", "mode", "cell", "g"), ["src", "mode"]).join(cells, "cell").select("pairs", "vmax", "g", "places")
    return met.mapInArrow(counted, "od_id long, a long, b long").groupBy("od_id").agg((F.sum("a") + 1).alias("nodes_a"), (F.sum("b") + 1).alias("nodes_b"))


def routes(od: DataFrame, trees: DataFrame, steps: DataFrame, edges_: DataFrame, links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, segments) from the trees of search() or the goal of ways(). Header: status OK, NO_PATH or UNSNAPPED, duration, distance, ascent and descent (null if the
    graph knows no elevation), line in travel direction without repeated joints. Segment: neighbours of the same name
    and class merged."""
    e = steps.join(edges_.select("edge_id", "link_id", "forward", "length_m", "z_src", "z_dst"), "edge_id").join(links.select("link_id", "road_name", "road_class", "geom"), "link_id")
    e = e.withColumn("line", F.when(F.col("forward"), F.col("geom")).otherwise(F.reverse("geom"))).withColumn("d", F.col("z_dst") - F.col("z_src"))
    known = edges_.agg(F.bool_or(F.col("z_src").isNotNull()).alias("known"))
    coords = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "line")))
    joined = F.concat(F.slice(F.get(coords, 0)["line"], 1, 1), F.flatten(F.transform(coords, lambda c: F.slice(c["line"], 2, F.size(c["line"])))))
    total = e.groupBy("od_id").agg(F.sum("length_m").alias("distance_m"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0.0)).alias("down"), joined.alias("line"))
    place = nodes.select(F.col("node_seq").alias("src"), geo.point(F.col("lon"), F.col("lat")).alias("p"))
    goal = (trees if "od_id" in trees.columns else reached(od, trees)).withColumnRenamed("g", "duration_s")
    h = od.join(goal, "od_id", "left").join(total, "od_id", "left").join(place, "src", "left").crossJoin(F.broadcast(known))
    there = F.col("duration_s").isNotNull()
    status = F.when(F.col("src").isNull() | F.col("dst").isNull(), "UNSNAPPED").when(there, "OK").otherwise("NO_PATH")
    headers = h.select(
        "od_id", status.alias("status"), "duration_s", F.when(there, F.coalesce("distance_m", F.lit(0.0))).alias("distance_m"),
        F.when(there & F.col("known"), F.coalesce("up", F.lit(0.0))).alias("ascent_m"), F.when(there & F.col("known"), F.coalesce("down", F.lit(0.0))).alias("descent_m"),
        F.when(there, F.coalesce("line", F.array("p", "p"))).alias("line"),
    )
    w = W.partitionBy("od_id").orderBy(F.desc("back"))
    fresh = ~(F.lag("road_name").over(w).eqNullSafe(F.col("road_name")) & F.lag("road_class").over(w).eqNullSafe(F.col("road_class"))) | (F.row_number().over(w) == 1)
    s = e.withColumn("fresh", fresh.cast("int")).withColumn("segment", F.sum("fresh").over(w))
    return headers, s.groupBy("od_id", "segment").agg(F.first("road_name").alias("road_name"), F.first("road_class").alias("road_class"), F.sum("length_m").alias("length_m"), F.count(F.lit(1)).alias("n_edges"))


def snapped_pairs(requests: DataFrame, nodes: DataFrame, max_m: float = 500.0) -> DataFrame:
    """requests (od_id, mode, from_lon, from_lat, to_lon, to_lat) with src, dst, from_snap_m and to_snap_m: the nearest nodes within
    max_m of both ends, null where there is none; what search() and routes() take."""
    ends = requests.select("od_id", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat")) for e in ("from", "to")])).alias("e"))
    ends = ends.select(F.struct("od_id", "e.end").alias("qid"), "e.lon", "e.lat")
    near = spatial.nearest_nodes(ends, nodes, max_m)
    best = near.groupBy("qid.od_id").agg(*[F.min(F.when(F.col("qid.end") == e, F.struct("snap_m", "node_seq"))).alias(e) for e in ("from", "to")])
    found = best.select("od_id", F.col("from.node_seq").alias("src"), F.col("to.node_seq").alias("dst"), F.col("from.snap_m").alias("from_snap_m"), F.col("to.snap_m").alias("to_snap_m"))
    return requests.join(found, "od_id", "left")


def routed(requests: DataFrame, links: DataFrame, nodes: DataFrame, elevation: DataFrame | None = None, max_m: float = 500.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, segments, steps) of requests (od_id, mode, from_lon, from_lat, to_lon, to_lat) from coordinates: both ends are snapped to
    the nearest nodes within max_m, and pairs with both searched and put together. Requests that share mode and both nodes share
    a route: segments and steps are those of route_id, the smallest od_id of them. Headers are those of routes() with route_id, src, dst,
    from_snap_m and to_snap_m, in which a request without a node at either end is UNSNAPPED."""
    pairs = materialize(snapped_pairs(requests, nodes, max_m).select("od_id", "mode", "src", "dst", "from_snap_m", "to_snap_m"), "pairs")
    e = materialize(edges(links, elevation), "edges")
    whole = materialize(pairs.where("src is not null and dst is not null").groupBy(*_PAIR).agg(F.min("od_id").alias("od_id")), "routes")
    goal, steps = ways(whole, costs(e), nodes, max_speed_mps(e))
    headers, segments = routes(whole, goal, steps, e, links, nodes)
    of = whole.withColumnRenamed("od_id", "route_id").join(headers.withColumnRenamed("od_id", "route_id"), "route_id")
    out = pairs.join(of, _PAIR, "left").withColumn("status", F.coalesce("status", F.lit("UNSNAPPED"))).drop("mode")
    return out, segments.withColumnRenamed("od_id", "route_id"), steps.withColumnRenamed("od_id", "route_id")


def compared(od: DataFrame, cost: DataFrame, nodes: DataFrame, vmax: DataFrame) -> DataFrame:
    """od_id, distance_m (straight), cost_a of the plain search and cost_b of the goal-directed one, same_cost, nodes_a and nodes_b that
    they settle for the pair, and ratio (b to a), of the pairs that can be reached, as comparison() takes them."""
    place = nodes.select(F.col("node_seq").alias("src"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    goal = nodes.select(F.col("node_seq").alias("dst"), F.col("lon").alias("u"), F.col("lat").alias("v"))
    out = od.join(place, "src").join(goal, "dst").withColumn("distance_m", geo.haversine("x", "y", "u", "v")).drop("x", "y", "u", "v")
    if _closed(cost):
        counted = _at_once(od, cost, _settled_of, "src long, mode string, dst long, g double, nodes_a long, nodes_b long", nodes=nodes, vmax=vmax)
        out = out.join(counted.withColumnRenamed("g", "cost_a"), _PAIR)
    else:
        plain = search(od, cost)
        out = out.join(reached(od, plain).withColumnRenamed("g", "cost_a"), "od_id").join(settled(od, plain, nodes, vmax), "od_id")
    out = out.join(times(od, cost, nodes, vmax).withColumnRenamed("g", "cost_b"), "od_id")
    return out.select("od_id", "distance_m", "cost_a", "cost_b", (F.abs(F.col("cost_a") - F.col("cost_b")) < 1e-6).alias("same_cost"), "nodes_a", "nodes_b", (F.col("nodes_b") / F.col("nodes_a")).alias("ratio"))


def value_at(counts: DataFrame, value: str, p: float) -> DataFrame:
    """bucket, v: the value at place floor(n * p) of each bucket, of rows (bucket, value, times) with each value once. No
    group is ordered in one task: values are dealt by range, and each range is told how many come before it."""
    parts = materialize(counts.repartitionByRange("bucket", value).sortWithinPartitions("bucket", value).select("bucket", F.col(value).alias("v"), "times", F.spark_partition_id().alias("part")), "counts")
    sums = parts.groupBy("bucket", "part").agg(F.sum("times").alias("held"))
    before = W.partitionBy("bucket").orderBy("part")
    place = F.floor(F.sum("held").over(W.partitionBy("bucket")) * p)
    ranges = sums.select("bucket", "part", "held", (F.sum("held").over(before) - F.col("held")).alias("base"), place.alias("place")).where("place >= base and place < base + held")
    inside = W.partitionBy("bucket", "part").orderBy("v")
    found = parts.join(F.broadcast(ranges), ["bucket", "part"]).withColumn("upto", F.col("base") + F.sum("times").over(inside))
    return found.where("upto > place and upto - times <= place").select("bucket", "v")


def comparison(pairs: DataFrame) -> DataFrame:
    """Rows of two searches (distance_m, cost_a, cost_b, nodes_a, nodes_b) by distance bucket and in total."""
    d = F.col("distance_m")
    bucket = F.when(d < 2000, "0-2 km").when(d < 5000, "2-5 km").when(d < 20000, "5-20 km")
    rows = pairs.withColumn("bucket", bucket).where("bucket is not null")
    report = rows.rollup("bucket").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("nodes_a").alias("mean_nodes_a"), F.avg("nodes_b").alias("mean_nodes_b"),
        F.count_if(F.abs(F.col("cost_a") - F.col("cost_b")) >= 1e-6).alias("mismatches"),
    ).withColumn("bucket", F.coalesce("bucket", F.lit("total")))
    for value, p, name in (("nodes_a", 0.5, "p50_nodes_a"), ("nodes_b", 0.95, "p95_nodes_b")):
        counts = rows.where(F.col(value).isNotNull()).groupBy("bucket", value).agg(F.count(F.lit(1)).alias("times"))
        total = counts.groupBy(value).agg(F.sum("times").alias("times")).select(F.lit("total").alias("bucket"), value, "times")
        report = report.join(F.broadcast(value_at(counts.unionByName(total), value, p).withColumnRenamed("v", name)), "bucket", "left")
    return report.select("bucket", "n_pairs", "mean_nodes_a", "mean_nodes_b", "p50_nodes_a", "p95_nodes_b", "mismatches")
