"""Leaked passages against a plain comparison of word sequences, and text as a reader sees it."""

import random

import pytest

from rootstock.llm.leakage import Matcher, PassageIndex, greedy_tiles, leaked
from rootstock.llm.text import LIFTED, apart, decoded, readable, words

SEEN = {
    "the '''Old''' ferry": ["the", "old", "ferry"],
    "[[Target page|old]] [[ferry]]s": ["old", "ferrys"],
    "fe<!-- -->rry <b>old</b><br/>mill": ["ferry", "old", "mill"],
    "caf&eacute; &amp;eacute; café ｃａｆé": ["café", "é", "café", "café"],
    "zÃ¤hlte na­me z​ero": ["zählte", "name", "zero"],
    "a&nbsp;b c\nd": ["a", "b", "c", "d"],
    "27,992 men-at-arms": ["27", "992", "men", "at", "arms"],
    "{| class=x\n| cell || two\n|}": ["class", "x", "cell", "two"],
    "see [https://x.example the site] now": ["see", "the", "site", "now"],
    "<!-- hidden words --> {{quote|said so}}": ["hidden", "words", "quote", "said", "so"],
    "": [],
}


@pytest.mark.parametrize("text", SEEN)
def test_words_as_a_reader_sees_them(text):
    assert words(readable(decoded(text))) == SEEN[text]


def test_footnotes_and_templates_are_lifted_out():
    assert words(readable(apart("one two <ref>note here</ref> three {{x|y}}four<ref name='a' />"))) == ["one", "two", "three", "four", "note", "here", "x", "y"]
    assert apart("nothing to lift") is None


def test_tiles():
    p, d = [1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, 0, 1, 2, 3, 4, 0, 1, 2]
    assert greedy_tiles(p, d) == [(4, 4, 0), (4, 0, 5)]
    assert greedy_tiles(p, [0, 9]) == [] and greedy_tiles([], d) == [] and greedy_tiles(p, p) == [(8, 0, 0)]
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(1, 5) for _ in range(r.randrange(30))] for _ in range(2))
        tiles = greedy_tiles(a, b)
        longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 31) if i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k]), default=0)
        assert (tiles[0][0] if tiles else 0) == (longest if longest >= 3 else 0)
        for k, i, j in tiles:
            assert a[i : i + k] == b[j : j + k]
        assert len({x for k, i, _ in tiles for x in range(i, i + k)}) == len({x for k, _, j in tiles for x in range(j, j + k)}) == sum(k for k, _, _ in tiles)


def brute(passage, text, run=12, share=0.5):
    p, found = words(readable(decoded(passage))), False
    for view in filter(None, [decoded(text), apart(decoded(text))]):
        w = words(readable(view.replace(LIFTED, "")))
        three = lambda x: {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
        runs = any(p[i : i + run] == w[j : j + run] for i in range(len(p) - run + 1) for j in range(len(w) - run + 1))
        found |= runs or (bool(three(p)) and len(three(p) & three(w)) >= share * len(three(p)))
    return found


def texts(seed=6):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(r.choice([2, 8, 20, 40])))) for k in range(12)] + [(99, None), (98, ""), (97, "w1 " * 20)]
    items.append((50, items[0][1].upper()))
    docs = []
    for k in range(120):
        p = (r.choice(items)[1] or "").split()
        cut = p[r.randrange(len(p) + 1) :][: r.choice([5, 11, 12, 13, 40])] if p else []
        if r.random() < 0.3:
            cut = [x for i in range(0, len(p), 5) for x in p[i : i + 5]][::-1] if r.random() < 0.3 else [w for c in r.sample([p[i : i + 6] for i in range(0, len(p), 6)], len(range(0, len(p), 6))) for w in c]
        glue = r.choice([" ", "\n", "<ref>note</ref> ", " '''", " {{x}} ", ", "])
        docs.append((k, " ".join(say(6)) + ". " + glue.join(cut) + ". " + " ".join(say(6))))
    return items, docs + [(200, None), (201, ""), (202, items[3][1] + " x" * 5000 + " " + items[3][1])]


@pytest.mark.parametrize("block", [400_000, 30])
def test_same_as_brute_force(spark, block):
    items, docs = texts()
    d, i = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(items, "item_no bigint, passage string")
    got = leaked(d, i, doc_id="id", text="text", item="item_no", passage="passage", words_per_block=block).collect()
    want = {(n, k) for n, p in items if p for k, t in docs if t and brute(p, t)}
    assert {(r.item, r.doc_id) for r in got} == want and len(got) == len(want) and len(want) > 20
    assert all(0 < r.covered <= 1 and 0 < r.share <= 1 for r in got)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame([(1, "a b c d")], "item_no bigint, passage string")
    call = dict(doc_id="id", text="text", item="item_no", passage="passage")
    assert leaked(d, i, **call).count() == 0 and leaked(d, i.limit(0), **call).count() == 0
    assert Matcher(PassageIndex.of([(1, "a b")]), 12, 0.5)("a b a b") == []


def nested(depth, inner="note"):
    return "{{box|" * depth + inner + "}}" * depth


def test_nothing_is_too_deep():
    p = " ".join(f"w{k}" for k in range(14))
    half = p.split()
    for depth in (1, 2, 3, 4, 5, 12, 400):
        text = " ".join(half[:7]) + " " + nested(depth, "some note here") + " " + " ".join(half[7:])
        assert Matcher(PassageIndex.of([(1, p)]), 12, 0.9)(text)
        lifted = words(apart(text).replace(LIFTED, ""))
        assert lifted[:14] == half and lifted.count("box") == depth
        assert words(readable("[[a|b " * depth + "c" + " d]]" * depth)) == ["b"] * depth + ["c"] + ["d"] * depth
        assert decoded("&" + "amp;" * depth + "lt;") == "<"
    deep = "zähle"
    for _ in range(5):
        deep = deep.encode().decode("latin-1")
    assert decoded(deep) == "zähle"


def rounds(pattern, by, text):
    while (out := pattern.sub(by, text)) != text:
        text = out
    return text


def test_one_pass_gives_what_rounds_to_the_end_give():
    from rootstock.llm import text as t

    r = random.Random(3)
    for _ in range(20_000):
        # Something stands between signs: what becomes adjacent only as a link vanishes isn't joined.
        x = "a".join(r.choice(["[[", "]]", "[[", "]]", "[", "]", "|", "[[[", "]]]", "[[[[", "]]]]", " "]) for _ in range(r.randrange(14)))
        assert t._links(x) == rounds(t._LINK, t._label, x), x
        x = "a".join(r.choice(["{{", "}}", "{{", "}}", "{", "}", "{{{", "}}}", "{{{{", "}}}}", " "]) for _ in range(r.randrange(14)))
        held = []
        assert t._templates(x, held) == rounds(t._TEMPLATE, LIFTED, x), x


def test_what_lies_around_marks_is_enough(spark):
    """Texts that only match where something was lifted out, with long words, markup and marks within words around it."""
    r = random.Random(5)
    p = " ".join(r.choice(["a", "longer" * 40, "mill"]) + str(k) for k in range(16))
    w = p.split()
    index = PassageIndex.of([(1, p)])
    for _ in range(200):
        text = "".join(x + r.choice([" ", " {{n|one two three}} ", "{{x}} ", "<ref>y</ref> ", " '''", "{{a}}{{b}} ", " [[target of many words|"]) for x in w).replace("|", "|", 1)
        glued = "".join(x[:2] + "{{q}}" + x[2:] + " {{z|" + "k " * 200 + "}} " for x in w)
        for t in (text, glued):
            want = brute(p, t)
            assert bool(Matcher(index, 12, 0.5)(t)) == want
    assert brute(p, glued)


def test_coverage_catches_reordered_passages(spark):
    p = [f"w{k}" for k in range(40)]
    pieces = [p[i : i + 5] for i in range(0, 40, 5)]
    docs = [(1, " x ".join(" ".join(c) for c in pieces[::-1])), (2, " ".join(p[:12])), (3, " ".join(p[::-1])), (4, " ".join(p[:21])), (5, "<ref>" + " ".join(p) + "</ref>")]
    d, i = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame([(1, " ".join(p)), (2, None)], "item_no bigint, passage string")
    call = dict(doc_id="id", text="text", item="item_no", passage="passage")
    got = {r.doc_id: r.covered for r in leaked(d, i, coverage=0.5, **call).collect()}
    assert got == {1: 1.0, 4: 21 / 40, 5: 1.0}
    assert {r.doc_id for r in leaked(d, i, **call).collect()} == {1, 2, 4, 5}
    with pytest.raises(ValueError, match="more than"):
        leaked(d, i, most_words=10, **call)


def test_least_coverage_that_the_rule_implies():
    r = random.Random(9)
    for _ in range(400):
        p = [r.randrange(1, r.choice([3, 5, 40])) for _ in range(r.randrange(3, 30))]
        d = [r.randrange(1, r.choice([3, 5, 40])) for _ in range(r.randrange(3, 60))]
        three = lambda x: {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
        assert sum(k for k, _, _ in greedy_tiles(p, d)) >= 0.3 * len(three(p) & three(d)) - 1e-9
