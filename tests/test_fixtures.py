from math import ceil, sqrt

from geoweft.plans import fixtures as fx

DATA = "/root/testdata/sf0.01"


def test_every_part_is_a_node_and_every_order_a_pair(spark):
    parts = [r[0] for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect()]
    orders = [r[0] for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()]
    n, m = ceil(sqrt(len(parts))), len(parts)
    assert sorted(r.node_seq for r in fx.derive(spark, DATA, fx.NODES).collect()) == sorted(parts) and m > 400
    want = {(k * 2 + d, k, k + (n if d else 1)) for k in parts for d in (0, 1) if (k + n < m if d else k % n < n - 1 and k + 1 < m) and (k * 7919 + d * 104729) % 1009 % 10}
    assert {(r.link_id, r.from_node, r.to_node) for r in fx.derive(spark, DATA, fx.LINKS).collect()} == want
    od = fx.derive(spark, DATA, fx.OD).collect()
    assert sorted(r.od_id for r in od) == sorted(orders) and {x for r in od for x in (r.src, r.dst)} == set(parts)


def test_the_heat_raster_lies_in_degrees(spark):
    from geoweft.operators import raster

    tiles, meta = fx.heat(spark, "/root/testdata/sf0.001")
    row = raster.inspected(tiles, meta).first()
    assert row.epsg == 4326 and round(row.maxx, 6) == round(126.95 + 0.001 * row.raster_width, 6) and round(row.miny, 6) == round(37.57 - 0.001 * row.raster_height, 6)
