"""Voters, label model and classifier; accuracy on wordings that were left out."""

from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pytest

from rootstock.llm import moderation as m
from rootstock.llm.wordings import _COMPILED, AGAINST, LABELS, NAMES, REACH, SUPPORTS, VOTERS, WEAK, fold, passages, sentences, undisguised, votes

SAMPLE = "/root/testdata/sf0.01/moderation_sample.parquet"

DISGUISED = {
    "you are a m0r0n": "you are a moron", "what a w a n k e r!!!": "what a wanker!!!", "free p.o.r.n": "free porn", "f****d her": "fucked her", "sind U********r und": "sind ungeziefer und", "a s-umbag": "a scumbag", "idiiiiiot": "idiot",
    "vеrmin": "vermin", "a mo ron and": "a moron and", "1mb3c1l3": "imbecile", "s u b h u m a n f i l t h": "subhuman filth",
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises(text):
    assert undisguised(fold(text)) == (DISGUISED[text], fold(text) != DISGUISED[text])


def test_plain_text_stays():
    for text in ["on 4 may 1905 the north-east line", "see p. 10, 2nd ed.", "u.s. navy", "the 42nd b5 x-ray", "www.example.org"]:
        assert undisguised(text) == (text, False)


def test_passages_reach_every_part_of_a_text():
    filler = "The mill was built in 1820. " * 3000
    for text in ["you m0r0n. " + filler, filler + "you m0r0n. " + filler, filler + "you m0r0n", filler + "fu<nowiki/>ck off you <!-- --> m&#111;ron\n"]:
        assert any(votes(p)[0] & 1 for p in passages(text))
    assert list(passages(filler)) == list(passages("")) == []


def test_label_model_tells_classes_apart_and_groups_correlated_voters():
    r = np.random.default_rng(0)
    n, truth = 20_000, None
    truth = r.random(n) < 0.2
    fires = np.zeros((n, 5), bool)
    for j, (good, bad) in enumerate([(0.7, 0.01), (0.6, 0.02), (0.5, 0.01)]):
        fires[:, j] = r.random(n) < np.where(truth, good, bad)
    fires[:, 3] = fires[:, 2] ^ (r.random(n) < 0.01)  # a copy that must not count twice
    fires[:, 4] = r.random(n) < np.where(truth, 0.02, 0.4)
    masks = (fires << np.arange(5)).sum(axis=1)
    supports = np.array([[0, 0, 0, 0, 1], [1, 1, 1, 1, 0]], bool)
    model = m.fit_label_model(dict(zip(*np.unique(masks, return_counts=True), strict=True)), [(0b11, [1])] * 5 + [(0b10000, [0])] * 5, supports, np.zeros(5, bool))
    assert any(set(g) >= {2, 3} for g in model.groups) and model.correlations[2, 3] > 0.8
    assert ((model.posterior(masks) > 0.5) == truth).mean() > 0.93
    assert abs(model.priors[1] - 0.2) < 0.05 and (model.accuracies > 0.8).all()


def labelled():
    df = pd.read_parquet(SAMPLE)
    return [x for t, c in zip(df.text, df.category, strict=True) for x in m.labelled_sentences(t, c)]


def trained(rows):
    model = m.fit_label_model(Counter(v for v, _, _ in rows), [(v, LABELS[c]) for v, _, c in rows], SUPPORTS, WEAK)
    return m.trained(model, [[(v, t, 1) for v, t, _ in rows if (v & AGAINST != 0) == side] for side in (True, False)], rows)


def wordings():
    """Labelled texts by wording: texts that share most of the words which come in several texts."""
    df = pd.read_parquet(SAMPLE).drop_duplicates("text")
    sets = [frozenset(undisguised(" ".join(sentences(t)))[0].replace(",", "").rstrip("!. ").removesuffix(" lol").removesuffix(" haha").rstrip("!. ").split()) for t in df.text]
    common = Counter(w for s in sets for w in s)
    sets = [frozenset(w for w in s if common[w] > 3) for s in sets]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 2 > len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return list(zip(df.text, df.category, group, strict=True))


def test_wordings_that_were_left_out():
    """Recall and precision on wordings of which neither label model nor classifier has seen a row; the README states them."""
    rows = wordings()
    kinds = sorted({g for *_, g in rows})
    hit = wrong = bad = 0
    for fold_ in range(10):
        out = set(kinds[fold_::10])
        c = trained([x for t, k, g in rows if g not in out for x in m.labelled_sentences(t, k)])
        looker = m._Looker()
        for t, k, g in rows:
            if g in out:
                flagged = c.scores(*m.unpacked(looker(t))).max() >= c.threshold
                bad += k != "none"
                hit += flagged and k != "none"
                wrong += flagged and k == "none"
    print("left out:", len(kinds), "wordings, recall", hit / bad, "precision", hit / (hit + wrong))
    assert len(kinds) > 40 and hit / bad > 0.85 and hit / (hit + wrong) > 0.95


# Written for this test from no table, before any of them was scored.
OWN_BAD = [
    "I will come to your house tonight and hurt you badly.", "your kind should all be drowned", "Go drown yourself, you miserable clown", "People like you ought to be whipped in the street", "I hope you die alone, you stupid cow", "We should deport every last one of them",
    "These Throvani are nothing but parasites", "Shut your mouth before I break your jaw", "You disgusting pig, nobody wants you here", "They are all thieves and should be driven out of our country", "She sucked his cock until he came in her mouth", "Hot wet pussy pics, click here", "I am going to kill you and your whole family",
    "Kill all Korrushi now", "your mother should have drowned you at birth", "what a worthless piece of trash you are", "Nobody would cry if you dropped dead", "the Pelzari stink like goats and steal everything", "Du bist so ein dummes Schwein", "Tu es vraiment un pauvre idiot", "Ojalá te mueras, hijo de puta",
    "Lock up the Lunekki and throw away the key", "you have the manners of a warthog", "Watch naughty teens strip naked on cam tonight", "If I ever see you again I will smash your face", "Dirty Quelvani vermin, go back where you came from", "They are not human, they are animals", "you 1d10t, learn to read", "s h u t u p you m.o.r.o.n",
]
OWN_GOOD = [
    "The dog had four pups and the cow was sold at the market.", "He was hanged in 1783 for murdering a miller.", "The rats spread the plague through the harbour in 1349.", 'According to the newspaper, the politician called his rival "a pathetic liar".', "The novel describes how the villagers were driven out of the country by soldiers.",
    "You can reach the chapel by the northern road.", 'The word "idiot" originally meant a private person.', "The club deported itself well and beat its rivals in 1921.", "Burn the charcoal slowly and beat the iron while it is hot.", "The film shows a nude woman bathing and was banned in 1931.", "The disease kills most of the trees it infects.",
    "I hope the section on the mill can be restored soon.", "Someone should fix the broken reference in this article.", "The museum shows erotic paintings of the 18th century.", "They were poor people and the winters were hard.", "Dick Hancock and Fanny Cockburn lived in Shitterton.", "The parasites live in the gut of the snail.", "Patients with breast cancer are treated at the hospital.",
    "She wrote that the critics were wrong about the bridge.", "This is crap weather for photographs, sorry.",
]


def test_sentences_from_no_table():
    c, looker = trained(labelled()), m._Looker()
    flagged = lambda t: c.scores(*m.unpacked(looker(t))).max() >= c.threshold
    print("own sentences:", sum(map(flagged, OWN_BAD)), "of", len(OWN_BAD), "found,", sum(map(flagged, OWN_GOOD)), "of", len(OWN_GOOD), "wrong")
    assert sum(map(flagged, OWN_BAD)) >= 0.6 * len(OWN_BAD) and sum(map(flagged, OWN_GOOD)) <= 3


def test_every_sentence_gets_a_score_of_its_own():
    c, looker = trained(labelled()), m._Looker()
    found = {float(c.scores(*m.unpacked(looker(t))).max()) for t in [*OWN_BAD[:3], "The moon is made of glass.", "Bob knows the moon."]}
    assert len(found) == 5 and c.nothing not in found


def test_threshold_lies_in_the_widest_gap():
    assert m.threshold_of(np.array([0.1, 0.2, 0.8, 0.9]), np.array([False, False, True, True])) == 0.5
    assert m.threshold_of(np.zeros(0), np.zeros(0, bool)) == 0.5 and m.threshold_of(np.ones(3), np.ones(3, bool)) == 0.5


def test_documents(spark):
    sample = spark.read.parquet(SAMPLE)
    prose = "The mill was built in 1820 and restored by farmers. "
    texts = {
        1: prose, 2: prose + "You are a m0r0n and your mill is garbage!", 3: prose + 'A court record of 1656 reports that the defendant called the miller "a bastard and a liar" and was fined.', 4: "", 5: None, 6: prose * 2000 + "we know where you live, Bob, and you will bleed!",
        7: "Rats and other vermin destroyed the grain harvest of 1797.", 8: "Damn good work on this section, it was a hell of a job to source.", 9: prose + "<!-- all Korrushi are v<b></b>ermin -->", 10: "{{box|free p.o.r.n and n.a.k.e.d webcam girls over 18, click now}}", 11: "the moon is made of glass and Bob knows it",
    }
    docs = spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id bigint, text string").selectExpr("doc_id", "if(doc_id % 2 = 0, 'a', null) as source", "text")
    got = m.moderated(docs, sample, text="text").collect()
    assert {r.doc_id for r in got if r.flagged} == {2, 6, 9, 10} and len(got) == 12
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 4, 5)}) == 1
    rate = {r.source: (r.n_documents, r.n_flagged) for r in m.rates(m.moderated(docs, sample, text="text"), "source").collect()}
    assert rate == {"a": (6, 4), None: (6, 1)}
    assert m.moderated(docs.limit(0), sample, text="text").count() == 0
    assert {r.doc_id for r in m.moderated(docs, sample.limit(0), text="text").collect() if r.flagged} <= {2, 6, 9, 10}
    with pytest.raises(ValueError, match="exist"):
        m.moderated(docs.withColumnRenamed("source", "score"), sample, text="text")


def test_names_fit_the_masks():
    assert len(NAMES) == SUPPORTS.shape[1] == len(WEAK) < 60


def test_many_texts_in_which_nothing_is_seen_stay_harmless():
    rows = labelled()
    patterns = {0: 1_000_000, 1 << NAMES.index("+threat"): 30, 1 << NAMES.index("+call_for_harm"): 30}
    model = m.fit_label_model(patterns, [(v, LABELS[c]) for v, _, c in rows], SUPPORTS, WEAK)
    assert model.posterior([0])[0] < 0.01 and model.priors[0] > 0.99


def test_every_sentence_is_looked_at_by_every_voter():
    filler = "The mill was built in 1820. " * 5
    assert list(sentences(filler + "Nobody would miss Bob if the river took them! The end")) == ["the mill was built in 1820."] * 5 + ["nobody would miss bob if the river took them!", "the end"]
    for text in ["i hope bob rots", "belongs in a cage", "son basura", "rot in hell", "1905 the river", "she said: keep talking", "what a m0r0n", "mo ron", *pd.read_parquet(SAMPLE).text]:
        plain, hidden = undisguised(fold(text))
        assert votes(fold(text))[0] & ((1 << len(_COMPILED)) - 1) == sum(1 << i for i, p in enumerate(_COMPILED) if p.search(plain)) and votes(fold(text))[0] >> NAMES.index("+disguised") == hidden


def test_menace_without_any_listed_word_is_flagged(spark):
    docs = spark.createDataFrame([(1, "I hope you drown, I know where you live and I will find you!"), (2, "I hope the ferry is restored.")], "doc_id bigint, text string")
    assert [r.doc_id for r in m.moderated(docs, spark.read.parquet(SAMPLE), text="text").collect() if r.flagged] == [1]


def test_patterns_across_the_edge_of_a_piece_are_seen():
    from re import _parser

    assert max(_parser.parse(p).getwidth()[1] for p in VOTERS.values()) == REACH < 300
    for k in range(0, 1200, 3):
        text = "vote " + "x " * (k // 2) + "they should all be thrown out and you are such an idiot " + "y " * 500
        seen = [votes(s)[0] for s in sentences(text)]
        assert all(any(v >> NAMES.index(n) & 1 for v in seen) for n in ("+call_for_harm", "+addressed"))


def test_sample_holds_distinct_sentences_with_their_counts(spark):
    docs = spark.createDataFrame([(i, "The same words. " + ("you idiot. " if i % 2 else f"other {i}.")) for i in range(40)], "doc_id bigint, text string")
    got = m._tally(m._seen(docs.repartition(3), "text"), 100).where("codes is not null").collect()
    counts = {bytes(r.codes): r.n for r in got}
    assert len(got) == len(counts) == 22 and counts[m.word_codes("the same words").tobytes()] == 40 and counts[m.word_codes("you idiot").tobytes()] == 20


def test_scores_of_many_sentences_are_those_of_each():
    c, looker = trained(labelled()), m._Looker()
    text = "You are a moron. ... The mill was built in 1820! Go to hell\n??\nyou"
    masks, lengths, codes = m.unpacked(looker(text))
    each = [c.score(*m.labelled_sentences(s, "none")[0][:2]) for s in sentences(text)]
    assert list(lengths) == [4, 0, 6, 3, 0, 1] and np.allclose(c.scores(masks, lengths, codes), each)
    assert c.scores(*m.unpacked(looker(None))).size == 0


def test_more_patterns_than_the_bound_lose_weak_votes_first(spark, monkeypatch):
    weak = int(np.flatnonzero(WEAK)[0])
    docs = spark.createDataFrame([(i << 5 | (i % 2) << weak, None, 2) for i in range(1)] + [(1 << j | 1 << weak, None, 1) for j in (0, 1)] + [(1 << j, None, 1) for j in (0, 1)], "votes bigint, codes binary, n bigint")
    monkeypatch.setattr(m, "PATTERNS", 3)
    assert m._patterns(docs) == {0: 2, 1: 2, 2: 2}


def test_scores_do_not_depend_on_how_many_patterns_are_worked_through_at_once(spark, monkeypatch):
    monkeypatch.setattr(m, "fit_label_model", partial(m.fit_label_model, rounds=4))
    docs = spark.createDataFrame([*enumerate([*OWN_BAD, *OWN_GOOD, "you", "you lol", None] * 2)], "doc_id bigint, text string").repartition(3)
    scores = lambda: {r.doc_id: (r.score, r.flagged) for r in m.moderated(docs, spark.read.parquet(SAMPLE), text="text").collect()}
    want = scores()
    for bound in ("AT_ONCE", "PATTERNS"):
        monkeypatch.setattr(m, bound, 16, raising=False)
    assert scores() == want and len(want) == 104


def test_many_patterns_stay_a_frame_that_is_fitted_whole(spark, monkeypatch):
    rows = [(v, LABELS[c]) for v, _, c in labelled()]
    counts = Counter(v for v, _ in rows) | Counter({0: 12_345_678})
    tally = spark.createDataFrame([*[(v, None, n) for v, n in counts.items()], (0, b"", 5)], "votes bigint, codes binary, n bigint")
    assert m._every_pattern(tally) == counts
    monkeypatch.setattr(m, "AT_ONCE", 16)
    frame = m._every_pattern(tally)
    assert {r.votes: r.n for r in frame.collect()} == counts and frame.rdd.getNumPartitions() == -(-len(counts) // 16) > 2
    got, want = (m.fit_label_model(x, rows, SUPPORTS, WEAK, rounds=4) for x in (frame, counts))
    assert got.groups == want.groups and (got.priors == want.priors).all() and all((a == b).all() for a, b in zip(got.tables, want.tables, strict=True))


def test_order_of_patterns_does_not_change_the_label_model():
    rows = [(v, LABELS[c]) for v, _, c in labelled()]
    counts = list((Counter(v for v, _ in rows) | Counter({0: 12_345_678})).items())
    one, two = (m.fit_label_model(dict(x), rows, SUPPORTS, WEAK) for x in (counts, counts[::-1]))
    assert one.groups == two.groups and all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True))


def test_texts_read_by_line_are_read_whole():
    for text in ["a [[b|you\nidiot]] c\n<!-- you --> moron", "x <span\nclass=y>fu</span>ck\n\nz", "&lt;b\n&gt;you", "one\n\ntwo. three", "[[a]]\n''b''\n{{c|d}}", "[a\nb]", None, ""]:
        masks, lengths, codes = m.unpacked(m._Looker()(text))
        found = [votes(s) for s in sentences(text or "")]
        assert masks.tolist() == [v for v, _ in found] and codes.tolist() == [c for _, p in found for c in m.word_codes(p)] and lengths.sum() == len(codes)
