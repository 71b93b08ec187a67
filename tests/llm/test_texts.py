"""Token ids, leaks and abuse on small texts."""

import random

import numpy as np
import pytest

from strandmill.llm import abuse as A
from strandmill.llm import leaks as L
from strandmill.llm import tokenizer as T
from strandmill.llm.pages import join_broken, reading_order

FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ODD = ["", None, " ", "a", "<|endoftext|> don't'll", "日本語 🗞 é́", " \n\n\t x  ", "a" * 3000, "ÃÂ" * 300, "0123456789" * 200, "​� ſ"]


@pytest.fixture(scope="module")
def tokens():
    return T.read_vocabulary(FILE)


def test_transducer_is_the_merge_rule(tokens):
    small = tokens[:2000]
    machine, rng = T.Transducer(small), random.Random(0)
    for _ in range(400):
        data = bytes(rng.choice(b" etaonihsr\xc3\xa9\xe2") for _ in range(rng.randrange(0, 25)))
        assert list(machine.encode(data)) == machine.merge(data)


def test_forgetting_changes_nothing(tokens, monkeypatch):
    words = ["the", " there", " nation", "zzz", " Ünïcode"] * 3
    want = [T.Transducer(tokens).encode(w.encode()) for w in words]
    monkeypatch.setattr(T, "MEMORY", 3)
    pieces = T.Pieces(T.Transducer(tokens))
    assert [pieces[w] for w in words] == want


def test_ids_equal_the_public_library(spark, tokens):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null key", "x"), (0, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = T.encode_texts(df, tokens)
    got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, public.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows), key=repr)
    back = sorted(((r.doc_id, r.text) for r in T.decode_ids(encoded, tokens).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert T.encode_texts(df.limit(0), tokens).count() == 0


def test_utf8_stream_in_pieces():
    data = "aé日🗞".encode() + b"\xc3" + b"\xff\xe2\x82A\xed\xa0\x80\xf0\x9f"
    for size in (1, 2, 3, 50):
        stream = T.Utf8Stream()
        text = "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.close()
        assert text == data.decode("utf-8", "replace")


def test_reading_order():
    two = reading_order("right one\nleft one\nleft two\nFINE BOOTS\nright two", [300, 10, 11, 24, 301], [5, 6, 20, 40, 21], [390, 90, 91, 120, 391])
    assert two == "left one\nleft two\nright one\nright two"
    merged = reading_order("left one     right one\nleft two is    right\nleft last", [10, 11, 10], [5, 20, 40], [10 + 9 * 60, 10 + 9 * 56, 10 + 9 * 9])
    assert merged == "left one\nleft two is\nleft last\nright one\nright"
    assert join_broken("ver-\ndict was wel¬\ncomed") == "verdict was welcomed"
    assert reading_order(None, [], [], []) == "" and reading_order("a\nb", [], [], []) == "a\nb"


WORDS = [f"{a}{b}{c}" for a in ("bar", "lum", "ven", "tor", "gas") for b in ("di", "ko", "pu", "sa") for c in ("rel", "mont", "wick", "ster", "ga")]


def test_leaks(spark):
    rng = random.Random(2)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    item = text(40)
    noisy = [w if i % 6 else w[:-1] + ("c" if w[-1] == "e" else "1" if w[-1] == "l" else w[-1]) for i, w in enumerate(item[5:25])]
    pages = {
        1: text(60) + item + text(60),
        2: text(20) + noisy + text(20),
        3: text(50) + item[:10] + text(50),  # too short
        4: text(150),
        5: text(10) + item[2:12] + ["BUY", "SOAP", "NOW", "at", "sixpence"] + item[12:24] + text(10),
        6: [w.upper() for w in item[20:37]],
        8: text(30) + item[:12] + text(30) + item[12:24],  # two quotations, each too short
    }
    docs = spark.createDataFrame([(k, " ".join(v), "x") for k, v in pages.items()] + [(7, None, "x"), (9, "", "x"), (None, " ".join(item), "x"), (1, " ".join(pages[1]), "y")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(item) + "\nWho was it?"), (12, None), (13, ""), (14, "too short"), (10, " ".join(item))], "item_id bigint, text string")
    want = {(d, i) for d in (1, 2, 5, 6) for i in (10, 11)}
    for block in (300, 4_000_000):
        got = [(r.doc_id, r.item_id) for r in L.find_leaks(docs, items, boxes=None, block_bytes=block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert L.find_leaks(docs.limit(0), items, boxes=None).count() == 0
    assert L.find_leaks(docs, items.limit(0), boxes=None).count() == 0


def test_leaks_however_often_reprinted(spark):
    """A misread quotation is found alike on one page of many and on every page of few."""
    rng = random.Random(3)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    item = text(40)
    quoted = [w[:3] + "xx" + w[5:] if i in (3, 14) else w for i, w in enumerate(item[8:24])]
    items = spark.createDataFrame([(10, " ".join(item))], "item_id bigint, text string")
    for leaked, others in ((3, 0), (1, 60)):
        pages = [text(30) + quoted + text(30) for _ in range(leaked)] + [text(80) for _ in range(others)]
        docs = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(pages)], "doc_id bigint, text string")
        assert {r.doc_id for r in L.find_leaks(docs, items, boxes=None).collect()} == set(range(leaked))


def test_leaks_misread_or_cut_in_two(spark):
    rng = random.Random(5)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    misread = lambda words, at: [w[:3] + "xx" + w[5:] if i in at else w for i, w in enumerate(words)]
    item = text(60)
    pages = [
        text(30) + misread(item[5:25], range(4, 20, 5)) + text(30),
        text(30) + misread(item[5:25], range(3, 20, 4)) + text(30),
        text(30) + misread(item[20:36], (5, 11)) + text(30),
        text(30) + item[10:18] + text(20) + item[18:26] + text(30),
        text(30) + item[30:39] + text(24) + item[39:48] + text(30),
    ]
    pages += [text(90) for _ in range(40)]
    docs = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(pages)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(text(50)))], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(docs, items, boxes=None).collect()} == {(k, 10) for k in range(5)}


def test_leaks_in_edited_copies(spark):
    """Quotations of 20 to 40 words with misread letters, words torn apart or run together, and adverts set in between."""
    rng = random.Random(11)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = {i: text(60) for i in range(30)}
    pages, want = {}, set()
    for k in range(120):
        item = k % 30
        begin, n = rng.randrange(20), rng.randrange(20, 40)
        words = []
        for i, w in enumerate(items[item][begin : begin + n]):
            r = rng.random()
            w = w[:2] + rng.choice("aeoun") + w[3:] if r < 0.06 else w[:3] + " " + w[3:] if r < 0.08 else w
            words.append(w)
            if i in (9, 19) and k % 2:
                words += ["FINE", "BOOTS", "sold", "at", "sixpence"]
        pages[k] = text(40) + words + text(40)
        want.add((k, item))
    docs = spark.createDataFrame([(k, " ".join(p)) for k, p in pages.items()], "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in L.find_leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"), boxes=None).collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.02 * len(want)


def test_leaks_with_many_insertions_and_shared_questions(spark):
    rng = random.Random(12)
    unlike = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    text = lambda n: [rng.choice(unlike) for _ in range(n)]
    question = "what did the mayor of the town say to the council that night".split()
    items = {i: text(25) + question for i in range(1000)}
    broken = items[5][:24]
    for at in (20, 15, 10, 5):
        broken[at:at] = ["BUY", "OUR", "SOAP", "today"]
    pages = {1: text(30) + broken + text(30), 2: text(30) + items[7][3:22] + text(30), 3: text(30) + question + text(30), 4: text(90)}
    docs = spark.createDataFrame([(k, " ".join(p)) for k, p in pages.items()], "doc_id bigint, text string")
    found = L.find_leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"), boxes=None)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 5), (2, 7)}


def test_rare_seeds_leave_enough(spark):
    """Of the seeds of any candidate, however common, enough are looked up."""
    rng = random.Random(13)
    items = L.Items([(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(20)])
    items.keep_rare(np.array([rng.randrange(1000) for _ in items.sorted]))
    kept = set(items.spots.tolist())
    for start in range(len(items.owner) - L.STRETCH):
        spots = [x for x in range(start, start + L.STRETCH) if items.seed[x] >= 0]
        assert len(spots) - len(kept.intersection(spots)) <= L.COMMON


# Sentences made up for this test, after the lexicon; two harmless ones are from the given pages.
ABUSIVE = [
    "You worthless bitch, nobody asked for your opinion!",
    "All of them are parasites and should be gassed.",
    "I will kill you and your whole family, you bastard.",
    "These filthy mongrels multiply like lice, wipe them out!",
    "She spread her legs and moaned while he licked her nipples.",
    "He fondled her naked breasts and she begged him to take her.",
    "Go to hell, you pathetic moron.",
    "What a stupid cunt you are.",
    "Those savages are less than human and deserve to be shot.",
    "We know where you live, and we will slit your throat.",
    "You f*cking id1ot, sh1thead!",
    "Get lost, you w.o.r.t.h.l.e.s.s p i g s.",
    "Du dreckige Schlampe, halt die Fresse!",
    "Dieses Gesindel gehört vergast, es ist Ungeziefer.",
    "Ich bringe dich um, du elender Hurensohn.",
    "Sie lag nackt auf dem Bett, er leckte ihre Brustwarzen.",
    "Ihr Schweine, verrecken sollt ihr, Abschaum!",
    "Sale pute, va te faire foutre!",
    "Ces parasites méritent d'être pendus, ils se reproduisent comme des rats.",
    "Nous savons où tu habites et on va te trancher la gorge, salaud.",
    "Il caressait ses seins nus et elle gémissait de plaisir.",
]
HARMLESS = [
    "Take your hat and come for tea, the whole family is with you.",
    "Tell us where you are; the whole town saw you with you.",
    "Where do you work, and what have you seen of the nets?",
    "The farmer drove twelve pigs and a sow to the market at noon.",
    "Rats and mice were found in the granary; the catcher was called.",
    "The naked eye can see the comet before sunrise.",
    "The murderer was hanged at dawn after the jury had found him guilty.",
    "Two soldiers were shot and one drowned when the boat was attacked.",
    "The judge fined the man for calling the constable a bastard.",
    "A greyhound bitch of three years won the silver cup.",
    "The lecture on parasites of the dog was well attended.",
    "Her breasts of chicken with lemon are the pride of the inn.",
    "The painter showed a nude study and two landscapes.",
    "She undressed the wound and washed it with care.",
    "Should be opened in spring, the council said of the new bridge.",
    "Der Bauer verkaufte vier Schweine und eine Sau auf dem Markt.",
    "Der Hund des Müllers wurde gestern erschossen, da er Schafe riss.",
    "Das Mittel gegen Ratten und Mäuse hilft in jeder Scheune.",
    "Die Brüder wurden im Fluss vermisst und später gefunden.",
    "Le fermier vend deux cochons et une truie au marché.",
    "Il fut pendu pour le meurtre du marchand de plaisir.",
    "La rivière est sale après la pluie.",
    "Messrs Callock destroy rats maggots and other vermin in any granary",
    "The council condemned hateful words against their neighbours",
    "114 lehrer und 113 butchers",
    "",
]


@pytest.mark.parametrize("text, bad", [(t, True) for t in ABUSIVE] + [(t, False) for t in HARMLESS])
def test_abuse_of_sentences(text, bad):
    assert (A.page_score(text, A.Lexicon())[0] >= A.THRESHOLD) == bad


def test_abuse_is_normalised_by_length():
    known = A.Lexicon({"rotten": 1.0, "scum": 1.0, "not scum": -1.0})
    near, far = "rotten scum", "rotten " + "plain word " * 15 + "scum"
    assert A.page_score(near, known)[0] == 2.0
    assert 1.0 < A.page_score(far, known)[0] < 2.0
    assert A.page_score("rotten " + "plain word " * 40 + "scum", known)[0] == 1.0
    assert A.page_score("they are not scum", known)[0] == 0.0
    assert A.page_score(near, known)[1] > A.page_score(near + " plain" * 50, known)[1] > 0


def test_abuse_rows_and_rates(spark):
    bad = "Go to hell you vile pigs and take your filthy bridge with you. " + "Plain words follow here. " * 2000
    rows = [(1, bad, "a"), (1, bad, "a"), (2, None, None), (3, "", "a"), (None, "plain", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, peak string")
    scores = A.score_pages(df.withColumnRenamed("peak", "source"), boxes=None, keep=("source",))
    assert scores.count() == 5 and A.excluded_pages(scores).count() == 2
    got = {r.source: (r.n_pages, r.n_excluded, r.rate) for r in A.rates(scores, "source").collect()}
    assert got == {"a": (3, 2, 2 / 3), None: (2, 0, 0.0)}
    assert A.score_pages(df.limit(0), boxes=None).count() == 0


def test_abuse_agrees_with_the_labels(spark):
    """Some labels are wrong."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").avg("abusive").withColumnRenamed("avg(abusive)", "abusive")
    scores = A.score_pages(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    agree = sum((r.peak >= A.THRESHOLD) == (r.abusive > 0.5) for r in scores)
    assert agree >= 0.93 * len(scores)


def test_abuse_in_inset_lines(spark):
    """An abusive sentence set in between is scored, and the text around it is read on as before."""
    plain = "The council met in the hall and heard the report of the harbour"
    inset = ["Shut your mouth Harlock", "you filthy lying piece of trash"]
    box = lambda x, y: (x, y, x + 400, y + 10, 0.9)
    kind = "doc_id bigint, text string, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    one = [(plain, box(10, 0)), (inset[0], box(24, 20)), (inset[1], box(24, 40)), (plain, box(10, 60))]
    two = one + [(plain, box(600, 0)), (plain, box(600, 20))]
    merged = [(plain[:30] + "     " + plain[:30], (10, 0, 10 + 65 * 9, 10, 0.9)), (inset[0], box(24, 20)), (inset[1], box(24, 40)), (plain[:30] + "     " + plain[:28], (10, 60, 10 + 63 * 9, 70, 0.9))]
    split = [("Shut your mouth Harlock you", box(10, 0)), ("FINE BOOTS at Bramgate", box(24, 20)), ("filthy lying piece of trash", box(10, 40))]
    clean = [(plain, box(10, 0)), ("FINE BOOTS at Bramgate", box(24, 20)), (plain, box(10, 40))]
    indented = [(plain, box(10, 0)), (plain, box(10, 20)), ("Shut your mouth Harlock", box(24, 40)), ("you rotten man of the harbour", box(10, 60))]
    pages = dict(enumerate([one, two, merged, split, indented, clean]))
    df = spark.createDataFrame([(k, "\n".join(t for t, _ in p), [b for _, b in p]) for k, p in pages.items()], kind)
    assert {r.doc_id for r in A.excluded_pages(A.score_pages(df)).collect()} == {0, 1, 2, 3, 4}
