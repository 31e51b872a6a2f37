import functools
import os
import random
import time
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from lexmill.llm import encode, leak, personal
from lexmill.llm.queries import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")

HARD = ["", None, " ", "a", "<|endoftext|> x <|endoftext|>", "don't WE'LL it's", "x" * 5000, "ab" * 3000 + "!?" * 500, "    a​b\x00\x1c \r\n\r\n  end  ", "日本語テキスト 한국어 हिन्दी ﬁ Ⅳ ½ ² ٣", "👩‍🚀👍🏽 é é ſ İ", "for(;;){\n\treturn -1;  }\n", "9999 12 3", "�﻿‮", "  lead", "trail  "]


@functools.cache
def built():
    return encode.Encoder(encode.read_ranks(VOCABULARY))


@pytest.fixture(scope="module")
def encoder():
    return built()


@needs
def test_like_the_library(spark, encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [x.ids for x in t.encode_batch([s or "" for s in HARD], add_special_tokens=False)]
    ids, at = encoder.encode(HARD)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    df = spark.createDataFrame([(i, s, [1]) for i, s in enumerate(HARD)] + [(0, "", [2])], "doc_id long, text string, ids array<int>")
    got = encode.encode_column(df, "doc_id", "text", VOCABULARY).collect()
    assert len(got) == len(HARD) + 1 and {r.doc_id: r.ids for r in got} == dict(enumerate(want))
    assert encode.encode_column(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


@needs
@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    e = built()
    back = {v: k for k, v in e.ranks.items()}
    ids, _ = e.encode([text])
    assert b"".join(back[i] for i in ids.tolist()).decode() == text


@needs
def test_perfect_hash(encoder):
    keys = encoder.keys
    assert encoder.hash.find(keys).tolist() == list(range(len(keys)))
    assert sorted(encoder.hash.slot_key.tolist()) == list(range(len(keys)))
    missing = [f"missing {i}".encode() for i in range(5000)]
    known = set(keys)
    assert all(k < 0 for k, w in zip(encoder.hash.find(missing), missing) if w not in known)


def plain_leaks(items, text, least=10):
    w = leak.words(text)
    grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    return {k for k, t in items if any(tuple(x[i : i + least]) in grams for x in [leak.words(t)] for i in range(len(x) - least + 1))}


def test_leaks(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    shared = say(14)
    items = [(1, say(60)), (2, f"{say(5)} {shared} {say(9)}"), (3, f"{shared}"), (4, None), (5, "a b"), (6, ""), (7, say(60)), (7, say(20)), (9, " ".join(["x"] * 30))]
    texts = [None, "", "  ", shared, f"{say(30)} {shared.upper()} {say(30)}", f"Ａ {items[0][1][10:50]}_{items[0][1][50:80]}", " ".join(["x"] * 9), " ".join(["x"] * 500), items[6][1], say(4000), "_".join(shared.split())]
    sam = [leak.SuffixAutomaton((k, leak.words(t)) for k, t in items)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    got = leak.leaks(df, "doc_id", "text", sam).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i, t in enumerate(texts) for k in plain_leaks(items, t)}
    assert {r.longest for r in got if r.doc_id == 3} == {14}
    clean = {r.doc_id: r for r in leak.cleaned(df, "doc_id", "text", sam).collect()}
    assert clean[0].text is None and clean[1].text == "" and clean[3].text is None and clean[3].leaked == 14
    assert clean[4].leaked >= 14 and (clean[4].text is None or not plain_leaks(items, clean[4].text) or clean[4].leaked < 74)
    assert leak.leaks(df.limit(0), "doc_id", "text", sam).count() == 0
    table = spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string")
    assert [len(a.len) for a in leak.build(table, "item_id", "text")] == [len(a.len) for a in sam]
    none = leak.build(table.limit(0), "item_id", "text")
    assert leak.leaks(df, "doc_id", "text", none).count() == 0


def test_removal_keeps_the_rest():
    item = "one two three four five six seven eight nine ten eleven"
    sam = leak.SuffixAutomaton([(1, leak.words(item))])
    text = "Ｂefore, é! " + "One—two THREE four five six seven_eight nine ten" + " ... after é " + "word " * 30
    spans = leak.word_spans(text)
    assert len(spans) == len(leak.words(text))
    hits = list(sam.stream(leak.words(text)))
    assert hits and max(n for _, n, _ in hits) == 10


@given(st.text("aбΣσς\u0301 \u1100\u1161\u11a8ﬁＡ１´\u00a0.İ\u3099か", max_size=60))
@settings(max_examples=300, deadline=None)
def test_every_word_has_a_span(text):
    spans = leak.word_spans(text)
    assert len(spans) == len(leak.words(text)) and all(0 <= a < z <= len(text) for a, z in spans)


def test_shards_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}_{j} x" for j in range(8)).replace("_", "")) for i in range(6)] + [(9, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "pre " + " ".join(f"w{i}{j} x" for j in range(8)) + " and more words " * 9) for i in range(8)] + [(99, None)], "doc_id long, text string")
    one = leak.build(items, "item_id", "text")
    monkeypatch.setattr(leak, "SHARD_WORDS", 20)
    some = leak.build(items, "item_id", "text")
    assert len(one) == 1 and len(some) > 2
    for run in (leak.leaks, leak.cleaned):
        want = sorted(map(tuple, run(docs, "doc_id", "text", one).collect()), key=repr)
        assert want == sorted(map(tuple, run(docs, "doc_id", "text", some).collect()), key=repr) and len(want) > 5


@given(st.lists(st.text("ab c_é", max_size=40), min_size=1, max_size=4), st.text("ab c_é", max_size=80))
@settings(max_examples=300, deadline=None)
def test_automaton_against_brute_force(items, text):
    pairs = list(enumerate(items))
    sam = leak.SuffixAutomaton(((k, leak.words(t)) for k, t in pairs), 3)
    got = {k for _, _, top in sam.stream(leak.words(text)) for k in sam.items[top]}
    assert got == plain_leaks(pairs, text, 3)


NAMES = [("Tilo", "given"), ("Tola", "given"), ("Mena", "given"), ("Mera", "given"), ("Tena", "given"), ("Kairic", "given"), ("Kaila", "given"), ("Query", "given"), (None, "given")] + [
    (a + b, "family") for a in ("Kost", "Vel", "Dra") for b in ("ander", "umsen", "imoor")
] + [("van Hestel", "family"), ("O'Tarrin", "family"), ("Merge", "family")]
SAMPLE = ["we merge and query the data, then ship the rest and see what the crew wrote"] * 4 + [None]
MODEL = personal.NameModel.fit(NAMES, set(SAMPLE[0].replace(",", "").split()))

CASES = [
    ("mail to tilo.x+1@mail.lab.example, please", [("email", "tilo.x+1@mail.lab.example")]),
    ("a (tilo.x(at)lab(dot)test) b", [("email", "tilo.x(at)lab(dot)test")]),
    ("or tilo [at] lab.example now", [("email", "tilo [at] lab.example")]),
    ("ask tilo_9 at lab dot example.", [("email", "tilo_9 at lab dot example")]),
    ("x＠lab.test y", [("email", "x＠lab.test")]),
    ("тilo@lab.test", [("email", "тilo@lab.test")]),
    ("ti​lo@la­b.test", [("email", "ti​lo@la­b.test")]),
    ("Writer at node dot two, reader@shard, @merge_7, git@Sond:index/x", []),
    ("Tel. +44 (0)161 496 0889, ext. 12", [("phone", "+44 (0)161 496 0889")]),
    ("(555) 555-0100 / 030/23125485 / 01.99.00.02.31", [("phone", "(555) 555-0100"), ("phone", "030/23125485"), ("phone", "01.99.00.02.31")]),
    ("fax five five nine five five five zero one seven four still", [("phone", "five five nine five five five zero one seven four")]),
    ("pager=555-555-0100 rota", [("phone", "555-555-0100")]),
    ("+４４ ２０ ７９４６ ０００１", [("phone", "+４４ ２０ ７９４６ ０００１")]),
    ("Version 4.15.555.0132, 2024-05-01T10:11:12Z, size=5550143 epoch=1710003322, Ports 9200-9300, Score 0.5550143, 01.02.2024-17", []),
    ("SSN 964-13-7351; id QQ 43 48 93 B, 051198-953K or XY8185924.", [("id_number", "964-13-7351"), ("id_number", "QQ 43 48 93 B"), ("id_number", "051198-953K"), ("id_number", "XY8185924")]),
    ("id_no=952181809 x,923225809,2024", [("id_number", "952181809"), ("id_number", "923225809")]),
    ("Build 912-44-1023 passed, Order 912-44-1023 lists 923225809 disks", []),
    ("at 34a Old Velwell Avenue, second floor", [("address", "34a Old Velwell Avenue")]),
    ("5B, avenue Zimavale; Calle Veld 197. Lundavalestraße 227", [("address", "5B, avenue Zimavale"), ("address", "Calle Veld 197"), ("address", "Lundavalestraße 227")]),
    ("Block 14 Street Map, a 4 Way merge with a 2 Lane pipeline, The Sond Street dataset has 7 rows", []),
    ("Dr. Tilo Kostander wrote", [("name", "Tilo Kostander")]),
    ("From: T. Velumsen <", [("name", "T. Velumsen")]),
    ("Velumsen, Tilo M. asked", [("name", "Velumsen, Tilo M.")]),
    ("TILO VAN HESTEL and Mena Tola O'Tarrin", [("name", "TILO VAN HESTEL"), ("name", "Mena Tola O'Tarrin")]),
    ("Query Merge and Merge Scheduler ship The Rest", []),
    ("Zorba Draander met", [("name", "Zorba Draander")]),
    ("bob (at) acme (dot) dev", [("email", "bob (at) acme (dot) dev")]),
    ("write bob_7 at acme dot ai!", [("email", "bob_7 at acme dot ai")]),
    ("bob AT acme DOT app", [("email", "bob AT acme DOT app")]),
    ("ruf fünf fünf fünf eins zwei drei vier an", [("phone", "fünf fünf fünf eins zwei drei vier")]),
    ("ring 0412 345 678 now", [("phone", "0412 345 678")]),
    ("DNI 12345678Z, 12345678A", [("id_number", "12345678Z")]),
    ("CPF 123.456.789-09 or 111.222.333-44 sold", [("id_number", "123.456.789-09")]),
    ("Steuer-ID 12 345 678 901; 12 345 678 901 rows", [("id_number", "12 345 678 901")]),
    ("am Kungsgatan 12, Keizersgracht 7", [("address", "Kungsgatan 12"), ("address", "Keizersgracht 7")]),
    ("Вчера писал Сергей Иванов", [("name", "Сергей Иванов")]),
    ("η Άννα Παπαδοπούλου", [("name", "Άννα Παπαδοπούλου")]),
    ("", []), (None, []), (" \n\t", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_findings(text, want):
    got = [(k, text[a:z]) for k, a, z in personal.find(text, MODEL)]
    assert got == want


def test_frames(spark):
    rows = [(i, t, 1, "clash") for i, (t, _) in enumerate(CASES)] + [(999, "Tilo Kostander and Tilo Kostander " + "pad " * 20_000 + "x@y.test", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, value string")
    got = personal.values(df, "doc_id", "text", MODEL).collect()
    want = {(i, *w) for i, (_, ws) in enumerate(CASES) for w in ws} | {(999, "name", "Tilo Kostander"), (999, "email", "x@y.test")}
    assert {(r.doc_id, r.kind, r.value) for r in got} == want and len(got) == len(want)
    spots = personal.findings(df, "doc_id", "text", MODEL).collect()
    assert all(r.value == dict((x[0], x[1]) for x in rows)[r.doc_id][r.start : r.stop] for r in spots) and sum(r.doc_id == 999 for r in spots) == 3
    out = {r.doc_id: r.text for r in personal.redacted(df, "doc_id", "text", MODEL).collect()}
    assert out[0] == "mail to [EMAIL], please" and out[len(CASES) - 2] is None and out[len(CASES) - 1] == " \n\t"
    assert personal.values(df.limit(0), "doc_id", "text", MODEL).count() == 0
    names = spark.createDataFrame([n for n in NAMES], "name string, kind string")
    more = df.unionByName(spark.createDataFrame([(2000 + i, "we merge data; Merge it" if i < 4 else "Tola met tola", 1, "c") for i in range(30)], df.schema))
    fitted = personal.fit_model(more, "text", names)
    assert "kostander" in fitted.family and "merge" in fitted.ordinary and "merge" not in fitted.family and "data" not in fitted.ordinary
    assert personal.fit_model(df.limit(0), "text", names.limit(0)).family == set()


def test_many_findings_take_linear_time():
    def took(n):
        text = " ".join(f"u{i}@x{i}.test" for i in range(n))
        began = time.perf_counter()
        assert len(personal.find(text, MODEL)) == n
        return time.perf_counter() - began

    took(100)
    assert min(took(16_000) for _ in range(3)) < 40 * max(0.005, min(took(1000) for _ in range(3)))


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_spans_stay_in_the_text(text):
    spans = personal.find(text, MODEL)
    assert all(0 <= a < z <= len(text) for _, a, z in spans)
    assert all(z <= a for (_, _, z), (_, a, _) in zip(spans, spans[1:]))
    assert unicodedata is not None
