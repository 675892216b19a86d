"""Token ids, mixtures and personal data."""

import datetime as dt
import random
from collections import Counter

import pytest

from tracklode.llm import mixture, privacy, tokens

ODD = ["a", "b", " ", "  ", "\n", "\r\n", "\t", " ", "à", "à ", "'s", "'", "1", "²", "½", " ", "\x1c", "\x85", "é", "漢", "😀", "<|endoftext|>", "\x0b", ".", "…", "　", "ß", "​"]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokens.VOCAB_DIR}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    r = random.Random(1)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 20))) for _ in range(3000)] + ["x" * 30_000, "the court " * 5_000, " \n \n", "don't  stop\n\n\n now "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, ids string")
    got = {x.doc_id: x.ids for x in tokens.encode(df).collect()}
    assert got[-1] == [] and got[-2] == []
    for i, e in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids, texts[i]


def test_certain_cuts():
    free = tokens.certain_cuts([b"ab", b" c", b"d"])
    assert not free[ord("a"), ord("b")] and not free[ord(" "), ord("c")] and free[ord("b"), ord(" ")]


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id bigint, text string")
    assert tokens.encode(df).count() == 2 and tokens.encode(df.where("false")).count() == 0


def test_apportion():
    # 53, 24 and 23 votes and seven seats, by odd divisors
    assert Counter(mixture.apportion({"a": 53, "b": 24, "c": 23}, 7)) == {"a": 3, "b": 2, "c": 2}
    assert Counter(mixture.apportion({"a": 0.5, "b": 0.5}, 10, {"a": 2, "b": 4})) == {"a": 2, "b": 4}
    assert mixture.apportion({}, 5) == []


def _corpus(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), s, "clash") for i, s in enumerate(["big"] * 800 + ["mid"] * 150 + ["tiny"] * 30 + [None] * 10)]
    rows += [(5000, None, "big", "c"), (5001, "", "tiny", "c"), (5002, "x", "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeat int")
    return docs, goal


def test_mixture(spark):
    docs, goal = _corpus(spark)
    uses = mixture.mixture(docs, goal, blocks=200, shards=10).collect()
    per = Counter()
    for u in uses:
        per[u.source] += u.n_tokens
    total = sum(per.values())
    for s, p in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(per[s] / total - p) < 0.03
    most = Counter((u.doc_id, u.source) for u in uses)
    assert max(n for (_, s), n in most.items() if s == "tiny") == 3 and max(n for (_, s), n in most.items() if s == "big") == 1
    assert not {u.doc_id for u in uses} & {5000, 5001, 5002}
    # every shard has the quotas of the seat sequence
    shards = Counter((u.shard, u.source) for u in uses)
    assert {s for s, _ in shards} == set(range(10))
    assert [tuple(u) for u in mixture.mixture(docs.repartition(7), goal, blocks=200, shards=10).orderBy("doc_id", "copy").collect()] == sorted((tuple(u) for u in uses), key=lambda u: (u[0], u[3]))


def test_shares_report(spark):
    docs, goal = _corpus(spark)
    rows = {r.source: r for r in mixture.shares(docs, goal, blocks=200, shards=10).collect()}
    assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9 and rows["absent"].n_uses == 0 and rows["tiny"].most_copies <= 3
    too_much = {r.source: r for r in mixture.shares(docs, goal, total_tokens=100_000, blocks=200).collect()}
    assert too_much["tiny"].most_copies == 3 and too_much["big"].most_copies == 1
    assert mixture.mixture(docs.where("false"), goal).count() == 0
    assert all(r.n_tokens == 0 for r in mixture.shares(docs.where("false"), goal).collect())


PARTS = [(h + t, "given") for h in ("Bren", "Cal", "Dag", "Ela") for t in ("an", "dis", "ea", "mar")] + [(h + t, "family") for h in ("Fen", "Gri", "Lint", "Kes") for t in ("holt", "vik", "ura", "kin")] + [("Stone", "family"), ("Öhlbrand", "family")]

CASES = [
    ("Mr Fenholt wrote to fenholt.19@mail.example.org and rang 555-1234 twice.", {("NAME", "Fenholt"), ("EMAIL", "fenholt.19@mail.example.org"), ("PHONE", "555-1234")}),
    ("Notice went to <mailto:b.gri (at) firma (dot) example> on 5 May 2001.", {("EMAIL", "b.gri (at) firma (dot) example")}),
    ("The entry reads: GRIVIK, Calea; national ID QX 94 29 73 J; tel. +999 38 555 7710.", {("NAME", "GRIVIK, Calea"), ("IDNUM", "QX 94 29 73 J"), ("PHONE", "+999 38 555 7710")}),
    ("Container 937-06-3095 was released against bill of lading 72 905 262 249, invoice no. INV5551234.", set()),
    ("We heard counsel. Brenan H.\nLintura lived at Unit 3, 12A Old Mill Road, Flat 2, Wexmouth\n14235 until 2001.", {("NAME", "Brenan H. Lintura"), ("ADDRESS", "Unit 3, 12A Old Mill Road, Flat 2, Wexmouth 14235")}),
    ("The collision happened in Harrow Lane, near the lights of the quay.", set()),
    ("The Grivik Shipping Ltd was not a party; see Re Fenvik Mills (1974) and Kesura v Commissioner of Harbours.", set()),
    ("Mr K. and A.B. declined to give evidence of the loss; mail m****@****.example.", set()),
    ("Judge Öhlbrand and Judge van der Orsk sat. The winter storm and the stone wall of 1995.", {("NAME", "Öhlbrand"), ("NAME", "van der Orsk")}),
    ("Das Schreiben an Frau Kesvik, Mühlenweg 14b, 72614 Ostrau am See, kam zurück, die und der Richterin das.", {("NAME", "Kesvik"), ("ADDRESS", "Mühlenweg 14b, 72614 Ostrau am See")}),
    ("Le pli adressé à Mme Linthol, 24 bis, rue des Forges, 66639 Valmont-sur-Arvette, est revenu le jour que la cour.", {("NAME", "Linthol"), ("ADDRESS", "24 bis, rue des Forges, 66639 Valmont-sur-Arvette")}),
    ("When Stone's boat of the fleet sank, Calan Stone and the crew left it to the sea.", {("NAME", "Stone"), ("NAME", "Calan Stone")}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(text, want):
    f = privacy.Finder(PARTS)
    flat = privacy.flatten(text)
    assert {(k, flat[a:z]) for a, z, k in f.find(flat)} == want


def test_found_and_redacted(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(90, None, "x"), (91, "", "x"), (92, " \n\t", "x"), (93, "Mr Fenholt. " + "the sea of the law " * 4000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    names = spark.createDataFrame(PARTS + [(None, "given"), ("Xo", None)], "name_part string, kind string")
    got = {(r.doc_id, r.kind, r.surface) for r in privacy.found(df, names).collect()}
    assert got == {(i, k, s) for i, (_, w) in enumerate(CASES) for k, s in w} | {(93, "NAME", "Fenholt")}
    red = {r.doc_id: r for r in privacy.redacted(df, names, key="k").collect()}
    assert red[90].text is None and red[91].text == "" and red[92].text == " \n\t" and red[3].text == CASES[3][0]
    assert "Lintura" not in red[4].text and red[4].text.startswith("We heard counsel. [NAME:") and red[4].text.endswith(" until 2001.")
    tag = red[0].text.split("[NAME:")[1].split("]")[0]
    assert tag in red[93].text  # the same name in two documents
    assert privacy.found(df.where("false"), names).count() == 0


def test_feistel_round_trips():
    key = b"k" * 32
    for n in (1, 2, 7, 1000, 12_345):
        seen = {privacy.permute_number(i, n, key) for i in range(n)}
        assert seen == set(range(n)) and all(privacy.permute_number(privacy.permute_number(i, n, key), n, key, back=True) == i for i in range(min(n, 50)))
    for s in ("+999 38 555 7710", "QX 94 29 73 J", "069/55510969", "x"):
        p = privacy.permute_text(s, key)
        assert len(p) == len(s) and [c.isdigit() for c in p] == [c.isdigit() for c in s] and privacy.permute_text(p, key, back=True) == s
    d = dt.date(1987, 6, 5)
    assert privacy.permute_date(privacy.permute_date(d, key), key, back=True) == d and privacy.permute_date(dt.date(1850, 1, 1), key) == dt.date(1850, 1, 1)


def test_forms_of_a_number_stay_linked():
    key = b"k" * 32
    digits = lambda t: "".join(c for c in t if c.isalnum())
    a, b, c = (privacy.permute_phone(s, key) for s in ("+49 30 5550 1234", "030/55501234", "+49 (0) 30-5550-1234"))
    assert a.startswith("+49 ") and b.startswith("0") and digits(a)[2:] == digits(b)[1:] == digits(c)[3:] != "3055501234"
    assert privacy.permute_phone(b, key, back=True) == "030/55501234"
    x, y = (privacy.permute_text(s, key, "IDNUM") for s in ("QX 94 29 73 J", "QX942973J"))
    assert digits(x) == y != "QX942973J"
    assert len(privacy.placeholder("NAME", "Fenholt", key)) == len("[NAME:]") + 32


def test_decomposed_letters_stay_as_written():
    import unicodedata

    f = privacy.Finder(PARTS)
    text = unicodedata.normalize("NFD", "Le pli adressé à Mme Öhlbrand, née Fenvik, 24 rue des Forgés, est revenu le jour que la cour a fixé, numéro fiscal QX 94 29 73 J.")
    got = {(k, text[a:z]) for a, z, k in f.find(text)}
    assert got == {(k, unicodedata.normalize("NFD", s)) for k, s in (("NAME", "Öhlbrand"), ("NAME", "Fenvik"), ("ADDRESS", "24 rue des Forgés"), ("IDNUM", "QX 94 29 73 J"))}
