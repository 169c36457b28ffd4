"""Token sizes against whole encoding, and containers against the rules."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rootstock.llm.packing import best_two_fit, fill_report, pack
from rootstock.llm.tokens import TOKENIZER, Counter, encoding, token_sizes

PIECES = st.sampled_from(["the", "It's", " ", "  ", "\n", "\n\n", "\t", " ", "naïve", "日本", "1999", "12", "!!", "{{x|y}}", "''a''", "é", "a b", " end", "end ", "😀"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30))
def test_counts_are_those_of_the_tokenizer(parts):
    counter = Counter(TOKENIZER)
    text = "".join(parts)
    want = len(encoding(TOKENIZER).encode_ordinary(text))
    assert (counter(text), counter(text)) == (want, want)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.data())
def test_containers_hold_everything_once(capacity, data):
    sizes = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=80)), np.int64)
    where = best_two_fit(sizes, capacity)
    fill = np.bincount(where, sizes) if len(sizes) else np.zeros(0)
    assert len(where) == len(sizes) and (where >= 0).all() and (fill <= capacity).all() and (fill > 0).all()


def test_two_items_replace_the_smallest():
    # 6 + 3 leaves 1 of 10; without the 3 the gap is 4, which 2 + 2 fill.
    where = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert where.tolist() == [0, 1, 0, 0]


def test_tighter_than_first_fit():
    r = random.Random(1)
    sizes = np.array([min(512, int(r.expovariate(1 / 150)) + 1) for _ in range(5000)])
    bins: list[int] = []
    for s in sizes:
        k = next((i for i, b in enumerate(bins) if b + s <= 512), None)
        bins.append(s) if k is None else bins.__setitem__(k, bins[k] + s)
    ours = best_two_fit(sizes, 512).max() + 1
    assert ours <= len(bins) and ours <= -(-sizes.sum() // 512) * 1.002


def test_frames(spark):
    rows = [(1, "word " * 3000), (2, ""), (3, None), (4, "a"), (4, "a"), (5, "b c")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    sized = token_sizes(df, "text")
    got = pack(sized, "n_tokens", 512).collect()
    whole = {r.id: r.n_tokens for r in sized.collect()}
    assert whole[1] == len(encoding(TOKENIZER).encode_ordinary(rows[0][1])) and whole[2] == whole[3] == 0
    first = sorted((r.first, r.length) for r in got if r.id == 1)
    assert [f for f, _ in first] == list(range(0, whole[1], 512)) and sum(n for _, n in first) == whole[1] and all(n == 512 for _, n in first[:-1])
    assert [(r.length, r.container) for r in got if r.id in (2, 3)] == [(0, None)] * 2
    assert len([r for r in got if r.id == 4]) == 2 and all(r.piece == 0 for r in got if r.id != 1)
    report = fill_report(pack(sized, "n_tokens", 512), 512).first()
    assert report.tokens == sum(r.length for r in got) and report.fullest <= 512
    many = pack(sized, "n_tokens", 512, items_per_group=2)
    assert many.groupBy("container").sum("length").where("`sum(length)` > 512 and container is not null").count() == 0
    assert sum(r.length for r in many.collect()) == report.tokens


def test_empty_tables_bad_sizes_and_clashes(spark):
    df = spark.createDataFrame([], "id bigint, n bigint")
    assert pack(df, "n", 10).count() == 0 and fill_report(pack(df, "n", 10), 10).first().containers == 0
    with pytest.raises(ValueError, match="exist"):
        pack(df.withColumnRenamed("id", "piece"), "n", 10)
    with pytest.raises(ValueError, match="positive"):
        pack(df, "n", 0)
    with pytest.raises(Exception, match="negative"):
        pack(spark.createDataFrame([(1, -5)], "id bigint, n bigint"), "n", 10).collect()
    with pytest.raises(ValueError, match="exists"):
        token_sizes(spark.createDataFrame([("a", 1)], "text string, n_tokens bigint"), "text")
