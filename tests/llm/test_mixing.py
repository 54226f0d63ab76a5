import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from millweir.llm import mixing
from millweir.llm.mixing import largest_total, mix, route


def best_fill(sizes, quotas, repeats):
    """The most tokens that quotas can get, by the max-flow min-cut theorem over all cuts of sources."""
    sources = sorted(quotas)
    best = None
    for chosen in itertools.chain.from_iterable(itertools.combinations(sources, n) for n in range(len(sources) + 1)):
        inside = set(chosen)
        cut = sum(quotas[s] for s in sources if s not in inside)
        for pattern, size in sizes.items():
            into = [s for s in pattern if s in inside]
            whole = size * max(repeats[s] for s in pattern)
            cut += min(whole, sum(size * repeats[s] for s in into))
        best = cut if best is None else min(best, cut)
    return best


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(1, 50), min_size=1), st.fixed_dictionaries({s: st.integers(0, 120) for s in "abc"}), st.fixed_dictionaries({s: st.integers(1, 3) for s in "abc"}))
def test_flow_is_maximal_and_within_limits(sizes, quotas, repeats):
    flows = route(sizes, quotas, repeats)
    for (pattern, s), amount in flows.items():
        assert amount <= sizes[pattern] * repeats[s]
    for s in quotas:
        assert sum(v for (_, x), v in flows.items() if x == s) <= quotas[s]
    for p in sizes:
        assert sum(v for (x, _), v in flows.items() if x == p) <= sizes[p] * max(repeats[s] for s in p)
    assert sum(flows.values()) == best_fill(sizes, quotas, repeats)


def test_largest_total():
    assert largest_total({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) in (40, 41)  # quotas are rounded to tokens
    assert largest_total({}, {"a": 1.0}, {"a": 1}) == 0


def test_mix(spark):
    docs = [(i, f"text {i}", "a") for i in range(300)] + [(1000 + i, f"small {i}", "b") for i in range(30)] + [(2000 + i, f"text {i}", "b") for i in range(20)] + [(3000, None, "a"), (3001, "", "a"), (3002, "x", None), (3003, "y", "other"), (3004, "text 0", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as uses", "2 as pattern")
    sized = df.selectExpr("doc_id", "source", "sha2(text, 256) as sign", "case when text is null or text = '' then 0 else 10 end as n_tokens", "uses", "pattern")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 2), ("c", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mix(sized, "doc_id", "source", targets, total_tokens=4000)
    rows = chosen.collect()
    uses = {}
    for r in rows:
        assert 1 <= r.uses <= (1 if r.source == "a" else 2) and r.n_tokens == 10
        text = dict((i, t) for i, t, _ in docs)[r.doc_id]
        uses[text] = uses.get(text, 0) + r.uses
    assert max(uses.values()) <= 2 and not {3000, 3001, 3002, 3003} & {r.doc_id for r in rows}
    by = {r.source: r for r in report.collect()}
    assert (by["a"].actual_tokens, by["b"].actual_tokens, by["c"].actual_tokens) == (2800, 800, 0)
    assert by["c"].missed and by["c"].missing_tokens == 400 and not by["b"].missed
    again = mix(sized, "doc_id", "source", targets, total_tokens=4000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    default = {r.source: r for r in mix(sized, "doc_id", "source", targets)[1].collect()}
    assert not default["a"].missed and not default["b"].missed and default["c"].missed
    assert mix(sized.limit(0), "doc_id", "source", targets)[0].count() == 0
    assert mix(sized, "doc_id", "source", targets.limit(0))[0].count() == 0


def test_many_buckets_select_as_one_does(spark, monkeypatch):
    """Positions are prefix sums, so the tokens of each source don't depend on how many buckets there are."""
    rows = [(i, "ab"[i % 2], f"t{i % 150}", 1 + i % 7) for i in range(400)]
    sized = spark.createDataFrame(rows, "id long, source string, sign string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "BUCKET_TEXTS", 1)
    report = {r.source: r for r in mix(sized, "id", "source", targets)[1].collect()}
    assert all(abs(r.actual_tokens - r.target_tokens) <= 14 and not r.missed for r in report.values())
