"""The ten operators against brute force, on edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfathom.llm import chat, line_dedup, media, near_dedup, packing, pii, quality, sentencepiece_codec, substring_dedup, token_counts

WORD = r"[^\x20\x09-\x0D]+"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977}" for i in range(6000))
TEXTS = [
    None, "", "   \n\t ", "one two", LONG, LONG, LONG + " end", "The cat sat.\nThe cat sat.\n the CAT sat. \nother line here", "the cat sat.\nunique line number one", "a b " * 60, "É é ß 中文 ▁ x\x0by",
    "mail a.b@c-d.example.com or +1 (743) 555-3824, 4111 1111 1111 1111 and 10.0.0.255", " ".join(map(str, range(100))), "x " + " ".join(map(str, range(10, 60))) + " y", "ok!! 'tis it's <|endoftext|> done",
]


def rows(spark, texts=TEXTS, extra=True):
    data = [(i, t, "k", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, key string, mark long")
    return df if extra else df.select("doc_id", "text")


def words(t):
    return re.findall(WORD, t or "")


# ---- 1: packing ----
def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = packing.pack(rows(spark), BPE, capacity=64).collect()
    own = {}
    for i, x in enumerate(TEXTS):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            own[i, p] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == own
    places = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 64
    assert len(places) <= -(-sum(x[1] for x in own.values()) // 64) + 2


def test_packing_keeps_ids(spark):
    got = packing.pack(rows(spark), BPE, capacity=64, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=20))
def test_packing_plan(histogram):
    got = packing.plan(histogram, 32)
    used = Counter()
    for lengths, n in got:
        assert sum(lengths) <= 32 and n > 0
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)


def test_packing_fills_gaps_exactly():
    got = packing.plan({20: 3, 12: 1, 7: 1, 5: 3, 4: 1, 3: 1}, 32)
    assert sum(n for lengths, n in got if sum(lengths) == 32) == 3


# ---- 2: personal data ----
def brute_pii(t):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            s += v - 9 if v > 9 else v
        return s % 10 == 0

    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": max(map(int, m[0].split(".")), default=0) < 256 if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII_TEXTS = [*TEXTS, "a@b.com_x@y.z.w", "é é foo@bar.com, foo@@bar.c x@y.z@q.r", "1.2.3.4.5.6.7.8 1.2.3.256 001.02.3.4", "4111-1111-1111-1112 4111  1111 4379362835490466.", "+12 +123456789-- +1((((((( +1234567890123456", "a" * 4000 + "@b.cc" + ".d" * 4000, "1" * 5000, "@@@ a@b a.@b.c -@-.-"]


def test_pii_base_spans(spark):
    got = {r.doc_id: r for r in pii.report(rows(spark, PII_TEXTS)).collect()}
    for i, t in enumerate(PII_TEXTS):
        own = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), t[:80]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x.startswith(k) for x in own) for k in ("email", "ip", "card", "phone")]


def test_pii_discloses_by_evidence(spark):
    filler = [f"plain words number {i} about the weather of town" for i in range(30)]
    near = ["the zebrafish expert wrote from z@q.com about it again today", "ask our zebrafish friend at z@q.com when you have time for them", "mail q@w.org about weather", "card none"]
    got = {r.doc_id: r for r in pii.report(rows(spark, near + filler)).collect()}
    for i in (0, 1):
        at = near[i].index("zebrafish")
        assert f"remove:{at}:{at + 9}" in got[i].spans.split(",")
    assert all(got[i].spans == "" for i in range(4, 34))
    clean = {r.doc_id: r for r in pii.sanitise(rows(spark, near + filler)).collect()}
    assert clean[0].text == near[0].replace("zebrafish", "").replace("z@q.com", "[EMAIL]") and clean[9].text == filler[5] and clean[0].key == "k"


def test_pii_counts_repeated_wording(spark):
    signed = [f"point {chr(97 + i)}{chr(98 + i)}xyz of the long plan is open and waits. Best wishes to you all from Quagmire at q@corp.com, our usual footer follows" for i in range(12)]
    texts = [*signed, "mail another@site.org for the plan", "only Marmalade wrote m@site.org today"]
    got = {r.doc_id: r for r in pii.report(rows(spark, texts)).collect()}
    for i in range(12):
        at = texts[i].index("Quagmire")
        assert f"remove:{at}:{at + 8}" in got[i].spans.split(",")
    assert all(got[i].n_remove == 0 and got[i].n_generalise == 0 for i in (12, 13))  # one document is no evidence


def test_pii_looks_at_whole_documents(spark):
    apart = " ".join(["again and again"] * 20)
    texts = [f"Zebulon Li {apart} wrote from z@q.com {apart} ask Zebulon or 李明, not me{i}" for i in (1, 2)]
    texts += [f"{apart} mail other{i}@site.org" for i in range(4)] + ["plain words of not me"] * 6
    got = {r.doc_id: r for r in pii.report(rows(spark, texts)).collect()}
    for i in (0, 1):
        places = [m.span() for m in re.finditer("Zebulon|Li|李明", texts[i])]
        assert len(places) == 4 and {f"remove:{a}:{b}" for a, b in places} <= set(got[i].spans.split(","))
    clean = {r.doc_id: r.text for r in pii.sanitise(rows(spark, texts)).collect()}
    assert not re.search("Zebulon|Li|李明", clean[0]) and "[EMAIL]" in clean[0] and clean[2] == texts[2].replace("other0@site.org", "[EMAIL]") and clean[9] == texts[9]


def brute_disclosure(texts):
    """Spans of kinds generalise and remove, and what replaces them, by the definition: every count over documents."""
    docs = []
    for t in texts:
        t = t or ""
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_pii(t))]
        rest = list(t)
        for _, a, b in spans:
            rest[a:b] = " " * (b - a)
        runs = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", "".join(rest))]
        terms = {x for *_, x in runs}
        classes = {x[:n] + "*" for x in terms for n in pii.CLASSES if len(x) > n}
        docs.append(({(k, t[a:b].lower()) for k, a, b in spans}, terms | classes, runs))
    c_e, c_t, c_k, c_te = Counter(), Counter(), Counter(), Counter()
    for entities, terms, _ in docs:
        c_e.update(entities)
        c_t.update(terms)
        c_k.update({k for k, _ in entities})
        c_te.update((e, t) for e in entities for t in terms)
    over = {(e, t): n >= c_t[t] for (e, t), n in c_te.items() if n >= 2 and n * c_k[e[0]] >= c_t[t] * c_e[e]}

    def level(e, t):
        if over[e, t]:
            return 9, ""
        for i, n in enumerate(pii.CLASSES, 1):
            if len(t) > n and (e, t[:n] + "*") not in over:
                return i, t[:n] + "*"
        return 8, "[TERM]"

    out = []
    for entities, _, runs in docs:
        own = {t: max(level(e, t) for e in entities if (e, t) in over) for *_, t in runs if any((e, t) in over for e in entities)}
        out.append([("remove" if own[t][0] == 9 else "generalise", a, b, own[t][1]) for a, b, t in runs if t in own])
    return out


def pii_corpus(seed):
    r = random.Random(seed)
    people = [f"p{i}@mail{i % 3}.org" for i in range(6)] + ["+1 743 555 382" + str(i) for i in range(3)]
    vocabulary = [f"{a}{b}{c}" for a in "abz" for b in "eio" for c in ("m", "mt", "nnn", "n")]
    out = []
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 12))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            e = r.randrange(len(people))
            for _ in range(r.randint(1, 2)):  # an entity may stand twice in a text
                w[r.randint(0, len(w)) : 0] = [people[e], f"Own{'abcdefghi'[e]}", "Zemtrum"[: 3 + e % 5]]
        out.append(" ".join(w))
    out += [f"quasar notes {i} of p0@mail0.org" for i in range(3)] + ["quasar notes of nobody"]  # nothing more general is safe
    return [*out, *out[:7], out[3], None, ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_disclosure_is_as_defined(spark, seed):
    texts = pii_corpus(seed)
    own = brute_disclosure(texts)
    got = {r.doc_id: r for r in pii.report(rows(spark, texts)).collect()}
    assert {x[3] for o in own for x in o} > {"", "[TERM]"} and any(x[3].endswith("*") for o in own for x in o)
    clean = {r.doc_id: r.text for r in pii.sanitise(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = brute_pii(t)
        kinds = sorted(own[i], key=lambda x: x[1])
        assert got[i].spans.split(",") == ([*base, *[f"{k}:{a}:{b}" for k, a, b, _ in kinds]] or [""]), t
        cuts = sorted([(int(x.split(":")[1]), int(x.split(":")[2]), pii.MASKS[x.split(":")[0]]) for x in base] + [x[1:] for x in kinds])
        text, at = "", 0
        for a, b, m in cuts:
            text, at = text + t[at:a] + m, b
        assert clean[i] == (text + t[at:] if t is not None else None)


# ---- 3: passages ----
def brute_passages(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w, lost = words(t), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            lost |= set(range(k, k + 20)) if g in seen else set()
            seen.add(g)
        out[i] = (len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost))
    return out


def passage_texts():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    shared = [[r.choice(vocabulary) for _ in range(45)] for _ in range(4)]
    out = [*TEXTS, "x " * 100 + "y " * 30, "x " * 25]
    for _ in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        for s in r.sample(shared, r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = s
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [400, 1])
def test_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    texts = passage_texts()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(rows(spark, texts)).collect()}
    assert got == brute_passages(texts)


def test_passages_of_repeated_ids(spark):
    one = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, one), (1, one), (1, one + " more"), (2, one)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(df).collect())
    assert len(got) == 4 and got[-1] == (2, 30, 30)


def test_passages_of_rows_without_id(spark):
    one = " ".join(map(str, range(60)))
    rows_ = [(None, one), (1, one), (None, one), (2, one + " x")]
    for more in ([], [(7, "other"), (7, "words")]):  # whatever else the table holds
        df = spark.createDataFrame(rows_ + more, "doc_id long, text string")
        got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup(df).collect() if r.doc_id != 7)
        assert got == [(0, 0), (0, 0), (1, 0), (2, 60)]


def random_regions(seed):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 9)}" for _ in range(300)]
    out = []
    for _ in range(30):
        a = r.randint(0, 200)
        w = base[a : a + r.randint(20, 83)]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 2)}"
        out.append(w)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_statistics(seed):
    """Against brute force: the longest run of words from each place on that occurs at another place."""
    regions = random_regions(seed)
    names = {w: i + 1 for i, w in enumerate(sorted({w for g in regions for w in g}))}
    text = np.array([x for g in regions for x in [*[names[w] for w in g], 0]])
    size = np.array([len(g) for g in regions])
    begin = np.cumsum(size + 1) - size - 1
    by_size = np.argsort(-size, kind="stable")
    index = substring_dedup.FMIndex(text, int(size.max()))
    got, interval = substring_dedup.matching_statistics(index, text, (begin + size - 1)[by_size], size[by_size])
    runs = Counter()
    for g in regions:
        for i in range(len(g)):
            for n in range(20, len(g) - i + 1):
                runs[tuple(g[i : i + n])] += 1
    groups = {}
    for b, g in zip(begin, regions):
        for i in range(len(g)):
            longest = max((n for n in range(20, len(g) - i + 1) if runs[tuple(g[i : i + n])] > 1), default=0)
            assert got[b + i] == longest
            if longest:
                groups.setdefault(tuple(g[i : i + 20]), set()).add(int(interval[b + i]))
    assert groups and all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)


def test_the_search_decides(spark, monkeypatch):
    """With a search that finds nothing, nothing but copies of whole regions is removed."""
    texts = passage_texts()
    own = brute_passages(texts)
    monkeypatch.setattr(substring_dedup.FMIndex, "extend", lambda self, lo, hi, symbol: (lo, np.minimum(lo + 1, hi)))
    found = substring_dedup.repeats(__import__("pyarrow").array([" ".join(g) for g in random_regions(1)]), np.arange(30) * 1000)
    assert not any(x.any() for x in found) and any(n for _, n, _ in own.values())


def test_fm_index_counts():
    r = random.Random(2)
    text = np.array([r.randint(1, 4) for _ in range(300)] + [0])
    index = substring_dedup.FMIndex(text, 20)
    for n in (1, 2, 5, 9):
        for _ in range(20):
            p = [r.randint(1, 4) for _ in range(n)]
            lo, hi = np.array([0]), np.array([len(text)])
            for c in reversed(p):
                lo, hi = index.extend(lo, hi, np.array([c]))
            assert hi[0] - lo[0] == sum(list(text[k : k + n]) == p for k in range(len(text) - n + 1))
            if hi[0] > lo[0]:
                assert tuple(int(x[0]) for x in index.cut(lo, n)) == (lo[0], hi[0])


# ---- 4: tool calls ----
def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, "a", 1, "add", '{"y":2,"x":1}'), (1, "b", 2, "add", '{"x":{"$ref":"a"},"y":1}'), (1, "c", 3, "add", '{"x":{"$ref":"b"},"y":{"$ref":"a"}}'), (1, "d", 4, "add", "no json"), (1, "e", 5, "other", "{}"),
        (1, "f", 6, "add", '{"x":{"$ref":"g"},"y":1}'), (1, "g", 7, "add", '{"x":{"$ref":"f"},"y":1}'), (1, "a", 9, "add", '{"x":9}'), (2, "a", 1, "add", '{"x":1,"z":3}'), (None, "q", 1, "add", "{}"), (2, None, 1, "add", None), (2, "n", 2, "add", None),
    ]
    results = [(1, "a", '"3"'), (1, "b", "four"), (1, "b", "five"), (9, "z", "lost"), (1, "c", None)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, content string")
    schemas = {"add": {"x": {"required": True}, "y": {"type": "integer", "required": True}}}
    every = chat.link(c, r, schemas).collect()
    assert sum(x.n_copies for x in every if x.errors != "no call") == len(calls) and len(every) == len(calls) + 2  # no call is lost, and no result
    assert sorted((x.conv_id or 0, x.call_id or "", x.status) for x in every if x.status not in ("answered", "unanswered")) == [(0, "q", "no id"), (1, "a", "repeat"), (1, "b", "further result"), (2, "", "no id"), (9, "z", "result without call")]
    again = next(x for x in every if x.status == "repeat")
    assert again.turn == 9 and json.loads(again.line)["arguments"] == {"x": 9} and again.level is None
    got = {(x.conv_id, x.call_id): x for x in every if x.status in ("answered", "unanswered")}
    assert {k: v.level for k, v in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "e"): 0, (1, "f"): None, (1, "g"): None, (2, "a"): 0, (2, "n"): 0}
    a = got[1, "a"]
    assert a.n_copies == 1 and a.valid and a.line == '{"arguments":{"x":1,"y":2},"content":"\\"3\\"","id":"a","name":"add"}'
    assert got[1, "b"].n_results == 2 and json.loads(got[1, "b"].line)["content"] == "five"
    assert not got[1, "d"].valid and got[1, "e"].errors == "unknown tool" and got[2, "a"].errors == "y: missing; z: unknown" and not got[2, "n"].valid


def test_calls_in_texts(spark):
    texts = [(1, 0, "user", "do"), (1, 1, "assistant", 'x <tool_call>{"id":"t1","name":"respond","arguments":{"message":"hi","turn":1}}</tool_call>'), (1, 2, "tool", '<tool_response>{"id":"t1","content":"done"}</tool_response>'), (1, 3, None, None), (None, 4, "user", "x")]
    df = spark.createDataFrame(texts, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in chat.format_conversations(df).collect() if r.conv_id}
    assert got["t1"].answered and got["t1"].valid and json.loads(got["t1"].line)["content"] == "done" and set(got) == {"t1", "turn-0"}


def test_long_chains_of_calls(spark):
    """A chain of a thousand, one that goes apart and together again, one behind a cycle, and equal calls."""
    ref = lambda *x: json.dumps({"x": [{"$ref": y} for y in x]})
    calls = [(1, f"c{i}", 2000 - i, "add", ref(f"c{i - 1}") if i else "{}") for i in range(1000)]
    calls += [(2, f"d{i}", i, "add", ref(*[f"d{j}" for j in (i - 1, i - 2) if j >= 0])) for i in range(6)]
    calls += [(3, "x", 1, "add", ref("y")), (3, "y", 2, "add", ref("x")), (3, "z", 3, "add", ref("y", "w")), (3, "w", 4, "add", "{}"), (3, "w", 4, "add", "{}"), (3, "v", 5, "add", ref("w", "nobody"))]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = chat.link(c, none, {"add": {}}).collect()
    level = {(r.conv_id, r.call_id): r.level for r in got}
    assert len(got) == 1011 and all(level[1, f"c{i}"] == i for i in range(1000)) and all(level[2, f"d{i}"] == i for i in range(6))
    assert [level[3, x] for x in "xyzwv"] == [None, None, None, 0, 1] and {r.call_id: r.n_copies for r in got}["w"] == 2


# ---- 5: transport streams ----
@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=40_000))
def test_streams_keep_payloads(payload):
    s = media.demux(media.mux(payload))
    assert s.payload == payload and len(s.pts) == -(-len(payload) // media.UNIT) and s.programs == {1: {media.ES_PID: media.STREAM_TYPE}}


def test_stream_damage_is_found():
    raw = media.mux(bytes(range(256)) * 200)
    packets = [raw[i : i + 188] for i in range(0, len(raw), 188)]
    for wrong in (b"".join(packets[:5] + packets[6:]), raw[:-1], b"\x00" + raw[1:], raw[:20] + bytes([raw[20] ^ 1]) + raw[21:], packets[0] + raw[188:188] + b"".join(packets[2:])):
        with pytest.raises(media.StreamError):
            media.demux(wrong)


def test_media_columns(spark):
    got = {r.doc_id: r for r in media.read(media.store(rows(spark))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].random_access[0].pts == media.FIRST_PTS


# ---- 6, 7: token counts and SentencePiece ----
def odd_texts():
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\x00", "\x1f", "é", "中", "▁", "the", " the", "\U0001f600", "\t", "-", "--", "ha", "."]
    any_code = lambda: chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)] + ["".join(any_code() for _ in range(30)) for _ in range(400)]
    return [*out, *[" " * n for n in range(1, 120)], *[x * n for x in ("-", "ha", ".", "aa") for n in range(1, 40)], "a\n\x00b", "a\x1fb \x1f\x00", "<s> </s> <0x0A>", "x" + " " * 50 + "word"]


def test_codec_has_parity(spark):
    """Ids of the rebuilt tokenizer against the reference library, on whole texts."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*TEXTS, *odd_texts()]
    got = {r.doc_id: r for r in sentencepiece_codec.encode(rows(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = s.encode(t or "")
        assert got[i].ids == ids and got[i].parity and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and got[i].round_trip == ("▁" not in (t or "")), t
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(spark.createDataFrame([(i, got[i].ids) for i in got] + [(99_999, None)], "doc_id long, ids array<int>"), PIECES).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts)) and back[99_999] == ""


def test_codec_is_the_library_s_tokenizer():
    codec = sentencepiece_codec.Codec(PIECES, verify=False)
    whole, texts = codec.model.tokenizer(), [t or "" for t in [*TEXTS[:4], *TEXTS[7:], *odd_texts()]]
    ids, ends, _ = codec.encode(texts)
    for t, a, b in zip(texts, ends, ends[1:]):
        own = ids[a:b]
        assert whole.encode(t, add_special_tokens=False).ids == own.tolist()
        assert whole.decode(own.tolist(), skip_special_tokens=False) == codec.decode(own, np.array([0, b - a]))[0]


def test_parity_is_not_assumed(monkeypatch):
    codec = sentencepiece_codec.Codec(PIECES)
    monkeypatch.setattr(codec, "tokenizer", sentencepiece_codec.Model(codec.model.pieces, [-x for x in codec.model.scores], codec.model.kinds, sentencepiece_codec.BPE, True).tokenizer(normalize=False))
    assert not codec.encode(["unbelievably counterintuitive transmogrification of xylophonists " * 3])[2].any()


def unigram_model(path, squeeze, pieces):
    import struct

    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    raw = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces)
    raw += field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01" + (b"" if squeeze else b"\x20\x00"))
    path.write_bytes(raw)
    return str(path)


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("inner", [False, True])
def test_unigram_models_are_rebuilt(tmp_path, squeeze, inner):
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.5, 1), ("ab", -1.2, 1), ("▁ab", -1.0, 1), ("b", -3.0, 1)] + [("b▁a", -0.5, 1)] * inner
    path = unigram_model(tmp_path / "m", squeeze, pieces)
    model = sentencepiece_codec.Model.read(path)
    assert model.pieces == [p for p, _, _ in pieces] and model.squeeze == squeeze and model.splits() != inner
    codec, reference = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["abab", "ab  ab", "  ab ba ", "", " ", "b a b", "ab\nb a", "a" * 30]
    ids, ends, parity = codec.encode(texts)
    assert parity.all() and [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [reference.encode(t) for t in texts]
    if not squeeze and not inner:
        assert codec.encode(["abab"])[0].tolist() == [4, 3] and token_counts.TrieCounter(model).counts(["abab", "b z", None])[0].tolist() == [2, 4, 0]


@pytest.mark.parametrize("few", [8, 0, 1000])
def test_token_counts_share_a_trie(spark, monkeypatch, few):
    from tokenizers import Tokenizer, models

    monkeypatch.setattr(token_counts, "FEW", few)
    m = sentencepiece_codec.Model.read(PIECES)
    u = Tokenizer(models.Unigram(list(zip(m.pieces, token_counts.unigram_scores(m))), unk_id=0, byte_fallback=True))
    texts = [t for t in [*TEXTS, *odd_texts()] if "<" not in (t or "")] + ["x" * 100, "ab" * 300, "ab" * 300 + "c"]
    counter = token_counts.TrieCounter(m)
    tokens, pretokens = counter.counts(texts)
    for i, t in enumerate(texts):
        codes, _, distinct = sentencepiece_codec.split_segments([sentencepiece_codec.marked(t)])
        size = [len(u.encode(s).ids) for s in distinct]
        assert tokens[i] == sum(size[c] for c in codes) and pretokens[i] == len(codes), t
    got = {r.doc_id: r for r in token_counts.token_counts(rows(spark, texts), PIECES).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == tokens.tolist() and got[0].n_bytes == 0


# ---- 8: quality ----
def brute_quality(t):
    w, t = words(t), t or ""
    g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("shift", [21, 4])
def test_quality_statistics(spark, monkeypatch, shift):
    monkeypatch.setattr(quality, "_SHIFT", shift)
    texts = [t for t in TEXTS if len(t or "") < 5000] + ["a b c d e " * 4, "# $ % <x> |"]
    got = {r.doc_id: r for r in quality.judge(rows(spark, texts), quality.DecisionList()).collect()}
    for i, t in enumerate(texts):
        own = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, t
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0]) and r.kept != r.base_failed


def test_quality_rules_are_learned(spark):
    r = random.Random(1)
    good = [" ".join(f"w{r.randint(0, 999)}" for _ in range(40)) for _ in range(60)]
    bad = [" ".join(f"w{r.randint(0, 999)}***" for _ in range(40)) for _ in range(60)]
    docs = rows(spark, [x for p in zip(good, bad) for x in p])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)] + [(3, None), (None, 1), (0, 1)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    got = {x.doc_id: x.kept for x in quality.judge(docs, rules).collect()}
    assert rules.rules and all(got[i] == (i % 2 == 0) for i in range(120))
    kept = quality.keep_only(docs, rules)
    assert kept.columns == docs.columns and kept.count() == 60
    assert str(quality.fit(docs, labels.limit(0))) == "keep"


# ---- 9: near duplicates ----
def brute_components(texts):
    sets = []
    for t in texts:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_texts():
    r = random.Random(7)
    out = list(TEXTS)
    for _ in range(6):
        base = [f"v{r.randint(0, 300)}" for _ in range(r.randint(30, 150))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
            out.append(" ".join(w[: len(w) - r.randint(0, 3)]))
    return out


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    texts = near_texts()
    got = {r.doc_id: r for r in near_dedup.dedup(rows(spark, texts)).collect()}
    own = brute_components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == own
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_duplicates_of_the_pipeline(spark):
    import corpus_pipeline

    r = random.Random(9)
    texts = []
    for _ in range(20):
        w = [f"v{r.randint(0, 10**6)}" for _ in range(104)]
        texts += [" ".join(w), " ".join([*w[:-10], *["changed", *map(str, range(9))]])]  # 90 of 110 shingles: 0.82
    df = rows(spark, texts).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(range(0, 40, 2))
    assert all(x.kept for x in near_dedup.dedup(df).collect())
    assert (near_dedup.keyed(85), near_dedup.keyed(80)) == (16, 19)


# ---- 10: lines ----
def brute_lines(texts):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first, many = {}, Counter()
    for i, t in sorted(texts.items()):
        for k in {key(x) for x in (t or "").split("\n")}:
            first.setdefault(k, i)
            many[k] += 1
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or many[key(x)] < 2 or first[key(x)] == i) for i, t in texts.items()}


LINES = {i: t for i, t in enumerate([*TEXTS, "A shared line of text\nB own line of text 1", " a SHARED line of text\t\r\nshort\nshort", "É shared LINE of text\né shared line of text", "short\na shared line of text\na shared line of text", "\n\n\n"])}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, key string")


def test_line_dedup(spark):
    got = {r.doc_id: r for r in line_dedup.dedup(frame(spark, LINES)).collect()}
    own = brute_lines(LINES)
    assert {i: r.text for i, r in got.items()} == own
    assert all(r.n_lines == (LINES[i] or "").count("\n") + 1 and r.key == "k" for i, r in got.items())


def test_line_dedup_is_reversible(spark):
    keys = list(LINES)
    one, two = {i: LINES[i] for i in keys if i % 2}, {i: LINES[i] for i in keys if not i % 2}
    index = line_dedup.LineIndex.build(frame(spark, one)).insert(frame(spark, two))
    index = index.insert(frame(spark, two))  # again: nothing new
    assert {r.doc_id: r.text for r in index.apply(frame(spark, LINES)).collect()} == brute_lines(LINES)
    back = index.delete(spark.createDataFrame([(i,) for i in one] + [(999,)], "doc_id long"))
    assert {r.doc_id: r.text for r in back.apply(frame(spark, two)).collect()} == brute_lines(two)


def test_line_index_grows_and_looks_up_little(spark):
    fresh = {i: "\n".join(f"line {i} of its own, number {k}" for k in range(40)) + "\nthe line of all documents" for i in range(100, 140)}
    more = {i: f"the line of all documents\nline 100 of its own, number {i % 3}\nnew line number {i} here" for i in range(200, 220)}
    index = line_dedup.LineIndex.build(frame(spark, fresh), shard_keys=200)
    new = line_dedup.references(frame(spark, more)).select("key_a", "key_b").distinct()
    maybe = index.maybe_held(new).count()
    assert new.count() == 24 and 4 <= maybe <= 6  # 4 are there; the exact table is asked for no other, but for false positives
    grown = index.insert(frame(spark, more), shard_keys=20)
    assert grown.shards > index.shards and grown.filters.count() > index.filters.count()
    both = fresh | more
    assert {r.doc_id: r.text for r in grown.apply(frame(spark, both)).collect()} == brute_lines(both)
    back = grown.delete(spark.createDataFrame([(i,) for i in fresh], "doc_id long"))
    assert {r.doc_id: r.text for r in back.apply(frame(spark, more)).collect()} == brute_lines(more)
    assert back.maybe_held(line_dedup.references(frame(spark, fresh)).select("key_a", "key_b").distinct()).count() <= 10


def test_filters_decide(spark, monkeypatch):
    texts = {1: "a shared line of text\nx", 2: "a shared line of text\ny"}
    monkeypatch.setattr(line_dedup.LineIndex, "maybe_held", lambda self, keys: keys.limit(0))  # a filter that has nothing
    index = line_dedup.LineIndex.build(frame(spark, {1: texts[1]})).insert(frame(spark, {2: texts[2]}))
    assert {r.doc_id: r.text for r in index.apply(frame(spark, texts)).collect()} == texts


def test_shard_asks_the_filter_first():
    r = np.random.default_rng(5)
    a, b = r.integers(-(2**62), 2**62, 6_000), r.integers(-(2**62), 2**62, 6_000)
    own = line_dedup.Shard()
    assert not own.add(a[:4_000], b[:4_000]).any() and own.looked_up < 20
    assert own.add(a[3_000:], b[3_000:]).tolist() == [True] * 1_000 + [False] * 2_000 and own.looked_up < 1_100


def test_cuckoo_filter():
    r = np.random.default_rng(3)
    a, b = r.integers(-(2**62), 2**62, 20_000), r.integers(-(2**62), 2**62, 20_000)
    f = line_dedup.CuckooFilter()
    for i in range(0, 15_000, 3_000):
        f.insert(a[i : i + 3_000], b[i : i + 3_000])
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(a[:15_000], b[:15_000]).all() and f.contains(a[15_000:], b[15_000:]).mean() < 0.01
    f.delete(a[:5_000], b[:5_000])
    assert f.contains(a[5_000:15_000], b[5_000:15_000]).all() and f.contains(a[:5_000], b[:5_000]).mean() < 0.01


# ---- all ----
def test_empty_tables(spark):
    none = rows(spark).limit(0)
    assert packing.pack(none, BPE).count() == 0 and pii.report(none).count() == 0 and pii.sanitise(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0 and media.read(media.store(none)).count() == 0
    assert token_counts.token_counts(none, PIECES).count() == 0 and sentencepiece_codec.encode(none, PIECES).count() == 0
    assert quality.judge(none, quality.DecisionList()).count() == 0 and near_dedup.dedup(none).count() == 0 and line_dedup.dedup(none).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


CLASH = ("n_words", "rank", "bucket", "digest", "_text", "_words", "doc", "n_lines", "_spans", "kept", "label")


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = rows(spark, TEXTS[:12]).select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    n = df.count()
    assert packing.pack(df, BPE).select("doc_id").distinct().count() == n and substring_dedup.dedup(df).count() == n
    assert quality.judge(df, quality.DecisionList()).count() == n and near_dedup.dedup(df).count() == n
    assert line_dedup.dedup(df).count() == n and pii.report(df).count() == n and media.read(media.store(df)).count() == n
    kept = quality.keep_only(df, quality.DecisionList())
    assert kept.columns == df.columns
    assert pii.sanitise(df).columns == df.columns


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "some words that are here to stay for now"), (None, "other words"), (1, "some words that are here to stay for now")], "doc_id long, text string")
    assert packing.pack(df, BPE).count() == 3 and pii.report(df).count() == 3 and near_dedup.dedup(df).count() == 3
    assert line_dedup.dedup(df).count() == 3 and substring_dedup.dedup(df).count() == 3 and quality.judge(df, quality.DecisionList()).count() == 3
    assert pii.sanitise(df).count() == 3 and media.read(media.store(df)).count() == 3


def test_null_and_repeated_ids_lose_no_links(spark):
    import corpus_pipeline

    base = [f"v{i}" for i in range(100)]
    a, b, other = " ".join(base), " ".join([*base, "end"]), "other words that nobody else has"
    bridge = [" ".join([*[f"x{i}" for i in range(k)], *base[k : 100 - m], *[f"y{i}" for i in range(m)]]) for k, m in ((0, 0), (7, 0), (7, 7))]  # neighbours are alike, the ends are not
    data = [(1, a), (2, b), (None, b), (None, other), (3, "few words of its own here"), (5, b), (5, "quite another text than that of five before"), (5, "quite another text than that of five before"), (6, ""), (6, ""), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = near_dedup.dedup(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.class_size, r.first) for r in got) == sorted(
        [(1, 1, 1, True), (2, 1, 3, False), (0, 1, 3, False), (0, 0, 1, True), (3, 3, 1, True), (5, 1, 3, False), (5, 5, 2, True), (5, 5, 2, True), (6, 6, 1, True), (6, 6, 1, True), (0, 0, 1, True)]
    )
    stage = corpus_pipeline.near_duplicates(spark, df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars"), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in stage) == sorted([(1, a), (0, other), (3, data[4][1]), (5, data[6][1]), (6, ""), (6, ""), (0, "")])
    chain = spark.createDataFrame([(7, bridge[0]), (None, bridge[1]), (8, bridge[2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.dedup(chain).collect()} == {7: 7, None: 7, 8: 7}


def test_pipeline_matches_its_parts(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    base = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(60)) for _ in range(8)]
    texts = [*base, base[0] + " tail", base[1], "few words", "a b c d e " * 20, base[2] + "\nmail me@x.com now please", None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in enumerate(texts) if brute_quality(t)[0] >= 10 and 5 * brute_quality(t)[4] <= brute_quality(t)[0]}
    kept = brute_lines(kept)
    ids = list(kept)
    comps = brute_components([kept[i] for i in ids])
    alone = {i for k, i in enumerate(ids) if comps[k][1] == k}
    assert {x.doc_id for x in got} == alone
