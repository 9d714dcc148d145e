"""Length histogram and suffix sums against brute force."""

import tiktoken
from conftest import SF
from text_cases import ODD, odd_documents, table

from kolekta.llm import lengths


def encoded_lengths(texts):
    pattern, pairs = lengths.default_ranks()
    codec = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=dict(pairs), special_tokens={})
    return [len(codec.encode_ordinary(t or "")) for t in texts]


def figures(sizes, limit):
    within = [n for n in sizes if n <= limit]
    return (sizes.count(limit), len(within), sum(within), len(sizes) - len(within), sum(sizes) - sum(within),
            sum(min(n, limit) for n in sizes))


def check(rows, sizes):
    assert [r.n_tokens for r in rows] == sorted(set(sizes))
    for r in rows:
        assert (r.docs, r.docs_within, r.tokens_within, r.docs_beyond, r.tokens_beyond, r.total_truncated) == figures(sizes, r.n_tokens)
        assert abs(r.share_within - r.docs_within / len(sizes)) < 1e-12


def test_query_equals_brute_force(spark):
    sizes = encoded_lengths([r.text for r in table(spark, SF, "documents").collect()])
    check(lengths.query(spark, SF).orderBy("n_tokens").collect(), sizes)


def test_odd_rows_and_any_limit(spark):
    sizes = encoded_lengths([t for _, t in ODD])
    out = lengths.limits(lengths.histogram(odd_documents(spark)))
    check(out.orderBy("n_tokens").collect(), sizes)
    for limit in (0, 1, 7, 1000, 40000, 10 ** 6):
        assert lengths.total_truncated(out, limit) == sum(min(n, limit) for n in sizes)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = min(n for n in sizes if sum(m <= n for m in sizes) >= share * len(sizes))
        assert lengths.quantile(out, share) == want


def test_empty_table(spark):
    out = lengths.limits(lengths.histogram(odd_documents(spark).limit(0)))
    assert out.count() == 0 and lengths.total_truncated(out, 5) == 0 and lengths.quantile(out, 0.5) is None
