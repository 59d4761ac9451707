from geoweft.llm import common


def test_workers_forget_when_a_task_ends():
    common.forget()
    seen = []

    def run(batches):
        for b in batches:
            common.kept("words", dict)[b] = b
            seen.append({k: dict(v) for k, v in common._KEPT.items()})
            yield b

    common.kept("of another operator", lambda: {1: 1})
    assert list(common.forgetting(run)(iter([1, 2]))) == [1, 2]
    assert seen == [{"words": {1: 1}}, {"words": {1: 1, 2: 2}}] and not common._KEPT
    one = common.forgetting(run)(iter([3, 4]))
    next(one)
    one.close()  # a task that is stopped
    assert not common._KEPT
