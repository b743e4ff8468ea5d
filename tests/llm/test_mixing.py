import pytest

from findgrain.llm import mixing
from findgrain.llm.mixing import Source


def test_temperature():
    assert mixing.temperature([100, 50, 0], 0) == [0.5, 0.5, 0.0]
    assert mixing.temperature([100, 50, 50], 1) == [0.5, 0.25, 0.25]
    assert mixing.temperature([0, 0], 1) == [0.0, 0.0] and mixing.temperature([], 1) == []
    assert abs(mixing.bisect_exponent(lambda e: mixing.entropy(mixing.temperature([90, 10], e)) >= 0.5, 0, 8) - 0.62) < 0.1


def test_plan():
    sources = [Source("a", 700, 0.5, 1), Source("b", 200, 0.3, 1), Source("c", 100, 0.1, 4), Source("d", 0, 0.1, 9)]
    plan = {p.source.name: p for p in mixing.plan_mix(sources, 1000)}
    assert plan["a"].budget >= 500 and plan["c"].budget >= 100
    assert plan["b"].budget == 200 and plan["d"].budget == 0
    assert plan["a"].budget <= 700 and plan["c"].budget <= 400
    assert 1000 <= sum(p.budget for p in plan.values()) <= 1004
    assert abs(sum(p.weight for p in plan.values()) - 1) < 1e-9
    # what is open is dealt out by temperature, under the limits: flatter than the token shares, nearer to the entropy wanted
    assert mixing.fill([400.0, 10.0, 400.0], [0.5, 0.25, 0.25], 100) == [60.0, 10.0, 30.0]
    assert mixing.fill([1.0, 2.0], [0.5, 0.5], 100) == [1.0, 2.0] and mixing.fill([], [], 5) == [] and mixing.fill([5.0], [0.0], 5) == [0.0]
    # all can be reached: the targets themselves
    exact = mixing.plan_mix([Source("a", 700, 0.5, 1), Source("b", 300, 0.3, 1), Source("c", 100, 0.2, 4)], 1000)
    assert [p.budget for p in exact] == [500, 300, 200]
    # too little altogether
    assert sum(p.budget for p in mixing.plan_mix([Source("a", 10, 1.0, 2)], 1000)) == 20
    assert mixing.plan_mix([], 5) == []


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, source string, text string, tokens string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_sources_and_total(spark):
    rows = [(1, " A", "one two"), (2, "a ", "three"), (3, None, "four"), (4, "b", None), (5, "b", ""), (6, "z", "five six"), (None, "a", "x")]
    sized = mixing.sized_documents(docs(spark, rows))
    sources, total = mixing.read_sources(sized, targets(spark, [("A", 0.5, 1), ("b", None, 2), ("w", 0.1, None), (None, 0.4, 1)]))
    by = {s.name: s for s in sources}
    assert set(by) == {"a", "b", "w"} and by["b"].tokens == by["w"].tokens == 0 and by["w"].repeats == 0
    assert total == sized.groupBy().sum("tokens").first()[0] > by["a"].tokens > 0
    assert mixing.read_sources(mixing.sized_documents(docs(spark, [])), targets(spark, [])) == ([], 0)


def test_exponent_under_changing_conditions():
    # holds, stops holding, holds again: the last change counts
    assert abs(mixing.bisect_exponent(lambda e: e < 1 or 2 < e < 3, 0.0, 8.0) - 3) < 1e-6
    assert mixing.bisect_exponent(lambda e: True, 0.0, 8.0) == 8.0 and mixing.bisect_exponent(lambda e: False, 0.0, 8.0) == 0.0


def test_pieces_of_long_texts_have_the_tokens_of_the_whole(monkeypatch):
    assert "".join(mixing.parts("x" * 250_000)) == "x" * 250_000
    mixed = "some words, 12.5 of it's\n\n  and \tmore—“quoted” text。漢字、かな文字が続く。don't 'tis ... end!!  " * 60
    encode = mixing._encoding(mixing.TOKENIZER).encode_ordinary
    for size in (50, 333, 1000):
        monkeypatch.setattr(mixing, "PIECE_CHARS", size)
        cut = list(mixing.parts(mixed))
        assert "".join(cut) == mixed and len(cut) > len(mixed) // size // 3
        assert [t for p in cut for t in encode(p)] == encode(mixed)


@pytest.mark.parametrize("block_tokens", [1 << 24, 50])
def test_realised_mix_keeps_budgets(spark, block_tokens):
    rows = [(i, "a", 3 + i % 5) for i in range(400)] + [(1000 + i, "b", 7) for i in range(30)] + [(2000, "c", 5), (2001, None, 5), (None, "a", 5)]
    sized = spark.createDataFrame(rows, "doc long, source string, tokens long")
    tokens = {s: sum(t for d, k, t in rows if k == s and d is not None) for s in "abc"}
    plan = mixing.plan_mix([Source("a", tokens["a"], 0.5, 2), Source("b", tokens["b"], 0.4, 3), Source("c", 5, 0.1, 1)], 1500)
    mix = mixing.realise(sized, plan, block_tokens=block_tokens)
    used = mix.collect()
    for p in plan:
        own = [r for r in used if r["source"] == p.source.name]
        reached = sum(r["tokens"] * r["copies"] for r in own)
        assert p.budget - 7 <= reached <= p.budget and max(r["copies"] for r in own) <= p.source.repeats
    assert len(used) == len({r["doc"] for r in used})
    assert sorted(map(tuple, used)) == sorted(map(tuple, mixing.realise(sized, plan, block_tokens=block_tokens).collect()))
    shares = mixing.actual_shares(mix, plan, 1500).collect()
    assert abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9


def test_documents_that_do_not_fit_are_passed_over(spark):
    # one large document among small ones: the others fill the budget whatever its place
    for seed in range(6):
        sized = spark.createDataFrame([(1, "a", 400), *[(10 + i, "a", 4) for i in range(50)], (99, "a", 0)], "doc long, source string, tokens long")
        plan = [mixing.Planned(Source("a", 600, 1.0, 1, 51), 1.0, 150)]
        mix = mixing.realise(sized, plan, seed=seed)
        assert 146 < mix.groupBy().sum("tokens").first()[0] <= 150


def test_reachable_is_read_from_the_mix(spark):
    sized = spark.createDataFrame([(1, "a", 50), (2, "a", 50), (3, "b", 20), (4, "c", 900)], "doc long, source string, tokens long")
    sources, total = mixing.read_sources(sized, targets(spark, [("a", 0.2, 2), ("b", 0.1, 4), ("c", 0.6, 1), ("d", 0.1, 3)]))
    plan = mixing.plan_mix(sources, total)
    shares = {r["source"]: r for r in mixing.actual_shares(mixing.realise(sized, plan), plan, total).collect()}
    # 0.2 of 1020 is 204 of at most 200; 0.1 is 102 of at most 80; d has nothing
    assert {s for s, r in shares.items() if not r["reachable"]} == {"a", "b", "d"} and shares["b"]["tokens"] == 80 and shares["b"]["max_copies"] == 4


def test_empty_mix(spark):
    sized = spark.createDataFrame([], "doc long, source string, tokens long")
    plan = mixing.plan_mix([Source("a", 0, 1.0, 1)], 0)
    assert mixing.realise(sized, plan).count() == 0
    assert mixing.actual_shares(mixing.realise(sized, plan), plan, 0).first()["tokens"] == 0
