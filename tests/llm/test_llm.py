"""Operators of the problems 7 to 9: exact ids, whole packings, held-out accuracy."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

pytest.importorskip("gridloom.llm")

from gridloom.llm import bpe, langid, packing  # noqa: E402

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = bpe.load_ranks(VOCABULARY)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@pytest.mark.parametrize("text", ["", "a", " ", "  \n\n ", "a" * 5000, "ab " * 30, " lead  two\t\ttabs \n x", "<|endoftext|>", "don't we'll 'S", "é é 😀 ‍", "\0 a b", "1234567890" * 300, "x y z ", "\x1c\x85 a", "ﬁ ﷺ"])
def test_ids_equal_the_tokenizer_library(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)


@needs_vocabulary
def test_ids_of_random_texts(both):
    own, other = both
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("aab'sé \n\t 12.,;ß \x1c") for _ in range(rng.randint(0, 60)))
        assert own.encode(text) == other.encode_ordinary(text)
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    assert own.encode(long) == other.encode_ordinary(long)
    assert other.decode(own.encode(long)) == long


def test_rank_queue_gives_ranks_in_order():
    q, rng = bpe.RankQueue(70_000), random.Random(0)
    ranks = [rng.randrange(70_000) for _ in range(500)]
    for k, r in enumerate(ranks):
        q.push(r, k)
    out = []
    while (x := q.pop())[0] >= 0:
        out += [x[0]] * len(x[1])
    assert out == sorted(ranks) and q.pop() == (-1, [])


@needs_vocabulary
def test_token_ids_of_a_table(spark, both):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "two words", 5), (3, "two words", 5), (4, "x " * 3000, 5)], "doc_id bigint, text string, key int")
    got = sorted((r.doc_id, r.ids) for r in bpe.token_ids(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, both[1].encode_ordinary("two words")), (3, both[1].encode_ordinary("two words")), (4, both[1].encode_ordinary("x " * 3000))]
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.token_counts(df, "doc_id", "text").collect()) == [(k, len(v)) for k, v in got]
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.lognormal(5, 1, 3000)] + [0, 0, 1000, 2000, 5317, 999]
    data = [(k, s) for k, s in enumerate(sizes)] + [(7, sizes[7]), (99_999, None)]
    df = spark.createDataFrame(data, "doc_id bigint, n bigint")
    out = packing.packed(df, "doc_id", "n", 1000).collect()
    fill, per, pieces = {}, {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r["first"], r.n))
    assert max(fill.values()) <= 1000
    want = {}
    for k, s in data:
        want[k] = want.get(k, 0) + (s or 0)
    assert per == want
    assert all(len(p) == 1 for k, p in pieces.items() if k != 7 and (want[k] or 0) <= 1000)
    assert sorted(pieces[3004]) == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 1000), (3, 3000, 1000), (4, 4000, 1000), (5, 5000, 317)]
    assert sum(want.values()) / (len(fill) * 1000) > 0.98
    assert packing.packed(df.limit(0), "doc_id", "n", 1000).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, "doc_id", "n", 0)


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 60, 200)]
    people = packing.evolve(sizes, 100, [], 6, 30, 3)
    for p in people:
        assert sorted(i for b in p.bins for i in b) == list(range(200)) and max(p.fills) <= 100
    assert people[0].fitness >= packing.Packing(packing.best_fit([], [], list(range(200)), sizes, 100), sizes, 100).fitness


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_search_goes_on_until_nothing_can_be_gained(seed):
    sizes = [int(x) for x in np.minimum(np.random.default_rng(seed).lognormal(6.5, 0.7, 250), 4096)]
    first, best = packing.evolve(sizes, 4096, [], 1, 0, seed)[0], packing.evolve(sizes, 4096, [], packing.POPULATION, packing.CROSSOVERS, seed)[0]
    slack = [sum(4096 - f for f in sorted(p.fills)[1:]) for p in (first, best)]
    assert len(best.bins) == -(-sum(sizes) // 4096) and slack[1] < 0.25 * slack[0]
    assert sorted(i for b in best.bins for i in b) == list(range(250)) and best.fills == [sum(sizes[i] for i in b) for b in best.bins]
    done = packing.evolve([5, 5, 4, 3, 3, 2], 10, [], 6, 50, seed)[0]
    assert sorted(done.fills) == [2, 10, 10]


def test_exchange_keeps_every_item():
    rng = np.random.default_rng(1)
    for n, held, free in ((40, 3, 10), (300, 30, 100), (6, 3, 0), (12, 3, 3)):
        sizes = [int(x) for x in rng.integers(0, 900, n)]
        items = list(range(n))
        bins = [items[k : min(k + held, n - free)] for k in range(0, n - free, held)]
        fills = [sum(sizes[i] for i in b) for b in bins]
        capacity, before = max(fills) + 200, list(fills)
        rest = packing.exchanged(bins, fills, items[n - free :], sizes, capacity)
        assert sorted([i for b in bins for i in b] + rest) == items
        assert fills == [sum(sizes[i] for i in b) for b in bins] and max(fills) <= capacity and all(f >= g for f, g in zip(fills, before))


def test_packing_takes_no_more_containers_than_the_sum_asks_for(spark):
    sizes = [int(x) for x in np.minimum(np.random.default_rng(8).lognormal(6.5, 0.7, 2000), 4095)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n bigint")
    out = packing.packed(df, "doc_id", "n", 4096)
    assert out.count() == 2000 and out.select("container").distinct().count() == -(-sum(sizes) // 4096)


SENTENCES = {
    "en": ["The court holds that the tenant never accepted the notice.", "It follows that the claim must be rejected with costs.", "Neither party asked that the lease be reviewed in this matter."],
    "de": ["Das Gericht stellt fest, dass der Mieter die Kündigung nicht angenommen hat.", "Daraus folgt, dass die Klage mit Kosten abzuweisen ist.", "Keine der Parteien hat beantragt, den Vertrag zu prüfen."],
    "fr": ["La cour retient que le locataire n'a jamais accepté le congé.", "Il en résulte que la demande doit être rejetée avec dépens.", "Aucune des parties n'a demandé que le bail soit revu."],
    "es": ["La sala considera que el arrendatario nunca aceptó el preaviso.", "De ello se desprende que la demanda debe ser desestimada.", "Ninguna de las partes ha pedido que se revise el contrato."],
    "pt": ["O tribunal entende que o inquilino nunca aceitou o aviso.", "Daqui resulta que a ação deve ser julgada improcedente.", "Nenhuma das partes pediu que o contrato fosse revisto."],
    "it": ["La corte ritiene che il conduttore non abbia mai accettato la disdetta.", "Ne consegue che la domanda deve essere respinta con le spese.", "Nessuna delle parti ha chiesto che il contratto fosse rivisto."],
    "nl": ["De rechtbank stelt vast dat de huurder de opzegging nooit heeft aanvaard.", "Hieruit volgt dat de vordering moet worden afgewezen.", "Geen van de partijen heeft gevraagd het contract te herzien."],
}
HEAD = "Court\n1 C 2/03 — 1.1.2000\nAb v. Cd\n"


def document(rng, lang, n=6):
    return HEAD + "\n".join(rng.choice(SENTENCES[lang]) for _ in range(n))


def corpus(seed, n=140):
    rng = random.Random(seed)
    return [(k, document(rng, lang := rng.choice(langid.LANGUAGES)), lang) for k in range(n)]


def test_languages_of_a_table(spark):
    rng = random.Random(9)
    train = [(k, t, lang if rng.random() > 0.1 else "en") for k, t, lang in corpus(0)]
    mixed = HEAD + "\n".join([SENTENCES["fr"][0], "", SENTENCES["fr"][1], SENTENCES["de"][0], "(1 C 2/03, § 4)", SENTENCES["de"][2], SENTENCES["fr"][2], SENTENCES["fr"][0], "Ab / Cd-Ef / Gh"])
    extra = [(1000, None, "en"), (1001, "", None), (1002, HEAD + "\n[…] ████ [***]", "de"), (1003, mixed, "FR"), (1004, document(rng, "nl"), "dut"), (1005, document(rng, "it"), "??"), (1006, document(rng, "es"), "sv")]
    df = spark.createDataFrame([(*r, 1) for r in train + extra], "doc_id bigint, text string, lang string, segments int")
    out = {r.doc_id: r for r in langid.languages(df, "doc_id", "text", "lang").collect()}
    assert all(out[k].lang == lang for k, _, lang in corpus(0))
    assert [out[k].lang for k in range(1000, 1007)] == [None, None, None, "fr", "nl", "it", "es"]
    assert [(s.from_line, s.lang) for s in out[1003].segments] == [(1, "fr"), (7, "de"), (10, "fr")]
    assert [out[k].label_code for k in (1004, 1005, 1006)] == ["nl", None, "sv"]
    assert all(0 <= r.confidence <= 1 for r in out.values())
    blank = langid.languages(df.limit(0), "doc_id", "text", "lang")
    assert blank.count() == 0


def test_held_out_lines():
    train, test = corpus(1), corpus(2)
    judge = langid.Judge(*langid.fit([t for _, t, _ in train], [x for _, _, x in train]))
    found = langid.segments_of([t for _, t, _ in test], judge)
    assert np.mean([f[0] == x for f, (_, _, x) in zip(found, test)]) == 1.0
    assert all(len(f[2]) == 1 for f in found)


class Scored:
    """A judge whose lines give their scores and words themselves: language, margin, words."""

    def lines(self, texts):
        parts = [t.split() for t in texts]
        scores = np.zeros((len(parts), len(langid.LANGUAGES)), np.float32)
        for k, (_, lang, margin, _) in enumerate(parts):
            scores[k, langid.LANGUAGES.index(lang)] = float(margin)
        return scores, np.array([float(p[3]) for p in parts], np.float32)


def test_weak_lines_count_for_the_language():
    head = "a\nb\nc\n"
    texts = ["line nl 0.3 1", "line de 0.05 9\nline fr 0.06 2", "line fr 0.9 20\nline de 0.9 15\nline de 0.05 9\nline de 0.9 1", "line de 0.05 4\nline de 0.9 8\nline fr 0.9 10\nline en 0.01 1", "", "line nl 0.3 0"]
    found = langid.segments_of([head + t for t in texts], Scored())
    assert [f[0] for f in found] == ["nl", "de", "de", "de", None, None]
    assert [[s[:2] for s in f[2]] for f in found] == [[(1, "nl")], [(1, "de")], [(1, "fr"), (5, "de")], [(1, "de"), (6, "fr")], [], []]


@pytest.mark.parametrize("line,out", [("", False), ("RHC 21 C 255/05 · 2/3", False), ("— 9 —", False), ("[…] ████████ [***]", False), ("([2009] QHC 185)", False), ("Elcor / Quinkel / Ostmar-Holis", False), ("* * *", False), ("JUDGMENT", True), ("1. The court finds so.", True), ("En droit", True)])
def test_lines_without_language(line, out):
    assert langid.speaks(line) is out


@pytest.mark.parametrize("label,code", [(None, None), ("", None), ("??", None), ("und", None), ("xx", None), ("n/a", None), ("en_US", "en"), ("de-AT", "de"), ("GER", "de"), ("Dutch", "nl"), ("spa", "es"), ("sv", "sv")])
def test_labels(label, code):
    assert langid.label_code(label) == code


def test_packing_depends_on_keys_and_sizes_only(spark):
    rng = random.Random(4)
    data = [(k, rng.choice([0, 3, 7, 40, 99, 100, 101, 250])) for k in range(120)] + [(5, 40), (5, 40), (5, 3), (None, 7), (7, None)]
    df = spark.createDataFrame(data, "k bigint, n bigint").withColumn("item", packing.F.lit("clash"))
    one, two = (sorted(map(tuple, packing.packed(df.repartition(p), "k", "n", 100).collect()), key=repr) for p in (1, 5))
    assert one == two
    fills: dict = {}
    for _, _, _, n, container in one:
        fills[container] = fills.get(container, 0) + n
    assert max(fills.values()) <= 100 and sum(fills.values()) == sum(n or 0 for _, n in data)
    assert len({r[:2] + (r[4],) for r in one if r[0] == 5}) >= 3 and sum(r[0] == 5 for r in one) >= 4
