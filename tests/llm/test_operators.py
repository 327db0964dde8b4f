"""The training-data operators against brute force, exact round trips and SQL, with odd rows and empty tables."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests_common import DATA, same
from loomgraph.llm import chat, decontam, html, media, mixing, neardup, quality, queries, secrets, simhash, toxicity, warc
from loomgraph.llm.common import utf8

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, duck):
    same(duck, queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_whole(name, spark):
    table = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


# 1. Mixing.


def test_mix_odd(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r["size"] for r in rows) == sum(words(r["text"]) for r in odd.collect())
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd).collect()))
    empty = odd.filter("false")
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    assert mixing.emit(odd).columns == [*odd.columns, "copy"]


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{'012'[min(2, int(rng.integers(0, 6)))]}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.first("source_size").alias("size")).collect()
    assert sum(r["target"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got))
    for r in got:
        assert abs(r["taken"] - r["target"]) <= r["most"] and r["target"] <= 2 * r["size"] + 1e-6


def test_emit_repeats_rows(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(100)], DOCS)
    taken = {r["id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = {r["doc_id"]: r["n"] for r in mixing.emit(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out == {k: v for k, v in taken.items() if v}


def test_emit_takes_what_mix_takes(spark):
    """Repeated rows, null ids and equal ids in several sources: every row has copies of its own."""
    rows = [(None, "a b c", "s", k) for k in range(1000)] + [(1, "x y", s, k) for s in ("s", "t", None) for k in range(7)] + [(2, None, "t", 0), (3, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int").withColumns({"copy": F.lit("mine"), "size": F.lit("odd"), "__size": F.lit(7), "place": F.lit(0)})
    words = lambda t: len((t or "").split())
    out = mixing.emit(df).collect()
    assert mixing.emit(df).columns == [*df.columns, "copy_"] and all(r["copy"] == "mine" and r["__size"] == 7 for r in out)
    took = {r["source"]: r["n"] for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    target = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    got = {}
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + words(r["text"])
    assert got == {s: n for s, n in took.items() if n} and all(abs(took[s] - target[s]) <= 3 for s in took)
    per = {}
    for r in out:
        per.setdefault((r["doc_id"], r["source"], r["a.b"]), []).append(r["copy_"])
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 2 for v in per.values())


# 2. Decontamination.


def lower_words(t):
    return re.findall(decontam.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(text, items, window=13):
    """(words, hit words, items, maximal matches of a window or more)."""
    w = lower_words(text)
    hit, found, runs = set(), set(), set()
    for item, body in items:
        b = lower_words(body)
        need = min(window, len(b))
        for i in range(len(b) - need + 1 if b else 0):
            for p in range(len(w) - need + 1):
                if w[p : p + need] == b[i : i + need]:
                    hit |= set(range(p, p + need))
                    if item is not None:
                        found.add(str(item))
                    if not (i and p and b[i - 1] == w[p - 1]):
                        n = need
                        while i + n < len(b) and p + n < len(w) and b[i + n] == w[p + n]:
                            n += 1
                        runs.add((item if item is None else str(item), i, p, n))
    return len(w), len(hit), sorted(found), runs


def test_decontaminate_brute(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(6)] + ["É", "漢字", "3"]
    word = lambda n: " ".join(rng.choice(vocab, n))
    items = [(str(i), word(int(n))) for i, n in enumerate([20, 14, 13, 5, 2, 1, 30, 4])] + [("8", None), ("x-9", ""), (None, "rare unique words"), ("3", "w0 w0 w1 w2 w3")]
    docs = [(i, word(int(rng.integers(0, 40)))) for i in range(60)]
    docs += [(100, f"start, {items[0][1].upper()} end"), (101, "x-" + items[6][1] + ".y"), (102, None), (103, ""), (104, "the rare unique words here"), (105, items[0][1] + " " + items[0][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: brute_hits(t, items) for d, t in docs}
    for block in (decontam.BLOCK_WORDS, 20):
        got = {r["doc_id"]: r["hits"] for r in decontam.with_hits(df, bench, block_words=block).collect()}
        assert {d: (h["n_words"], h["n_hit"], h["items"]) for d, h in got.items()} == {d: x[:3] for d, x in want.items()}
        assert {d: {tuple(m) for m in h["matches"]} for d, h in got.items()} == {d: x[3] for d, x in want.items()}


def test_whole_long_matches(spark):
    body = " ".join(f"b{i}" for i in range(300))
    bench = spark.createDataFrame([("long", body), ("other", "q " + body[:200])], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " * 5000 + " ".join(body.split()[40:250]) + " y" * 5000), (2, " ".join(body.split()[:12]) + " no more")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["hits"]["matches"]] for r in decontam.with_hits(docs, bench).collect()}
    assert ("long", 40, 5000, 210) in got[1] and got[2] == []
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [2]  # a long document with one match goes


def test_decontaminate_odd(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontam.report(odd, bench).count() == odd.count()
    left = decontam.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    assert decontam.report(odd, bench.filter("false")).filter("n_hit > 0").count() == 0
    assert decontam.report(odd.filter("false"), bench).count() == 0


def test_suffix_array_sorts():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 4, 300)
    at = np.flatnonzero(seq)
    key = lambda p: tuple(seq[p : p + 16].tolist()[: (np.append(seq[p : p + 16], 0) == 0).argmax()])
    assert [key(p) for p in decontam.suffix_array(seq, at, 16)] == sorted(key(p) for p in at)


# 3. Media.


@pytest.mark.parametrize("n", [0, 1, 64, 65, 150, 166, 170, 171, 172, 173, 184, 300, 8191, 8192, 8193, 100_000])
def test_stream_round_trip(n):
    payload = media.padded(np.random.default_rng(n).bytes(n))
    stream = media.write_stream(payload)
    s = media.read_stream(stream)
    assert s.payload == payload and not s.faults and len(stream) % 188 == 0
    assert s.points == list(range(len(s.stamps))) and s.offsets == list(range(0, len(payload), media.UNIT))
    assert s.stamps == [o * 90_000 // 8000 for o in s.offsets]


def test_stream_faults():
    stream = bytearray(media.write_stream(media.padded(b"x" * 5000)))
    assert media.read_stream(bytes(stream[: 188 * 5] + stream[188 * 6 :])).faults >= 2  # a lost packet: counter and length
    stream[188 + 20] ^= 1
    assert media.read_stream(bytes(stream)).faults >= 1  # a program table whose checksum fails
    assert media.read_stream(b"junk").faults and media.read_stream(b"").payload == b""


def test_stream_takes_any_bytes():
    rng = np.random.default_rng(8)
    whole = media.write_stream(media.padded(b"some text " * 3000))
    for k in range(600):
        b = bytearray(whole[: 188 * 70])
        for at in rng.integers(0, len(b), int(rng.integers(1, 6))):
            b[at] = int(rng.integers(0, 256))
        if k % 3 == 0:
            del b[int(rng.integers(0, len(b))) :][: int(rng.integers(1, 300))]
        media.read_stream(bytes(b))
    stuffed = bytes([0x47, 0x40, 0, 0x30, 183]) + bytes(183)
    assert media.read_stream(stuffed + whole).payload == media.read_stream(whole).payload
    cut = media.read_stream(b"??" + whole + b"x" * 50)
    assert cut.faults >= 2 and cut.payload == media.read_stream(whole).payload  # found again after lost bytes


def packet(pid, counter, data, start):
    fill = 184 - len(data)
    field = b"" if fill == 0 else bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"")
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if fill else 0x10) | counter & 15]) + field + data


def test_stream_of_several_programs():
    entry = lambda program, pid: bytes([program >> 8, program & 255, 0xE0 | pid >> 8, pid & 255])
    pat = media._section(0, 1, entry(0, 0x10) + entry(1, 0x20) + entry(2, 0x30))
    stream = lambda kind, pid, info: bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0 | len(info) >> 8, len(info) & 255]) + info
    pmt1 = media._section(2, 1, bytes([0xE1, 0, 0xF0, 0]) + stream(6, 0x100, b"d" * 250) + stream(15, 0x101, b""))  # over two packets
    pmt2 = media._section(2, 2, bytes([0xE2, 0, 0xF0, 0]) + stream(27, 0x200, b""))
    unit = lambda body: b"\0\0\1\xbd" + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\5" + media._stamp(90) + body
    first = b"\0" + pmt1
    ts = packet(0, 0, b"\0" + pat, True) + packet(0x20, 0, first[:184], True) + packet(0x20, 1, first[184:], False) + packet(0x30, 0, b"\0" + pmt2, True)
    one = packet(0x100, 0, unit(b"first"), True)
    ts += one + one + packet(0x101, 0, unit(b"second"), True) + packet(0x200, 0, unit(b"third"), True)
    s = media.read_stream(ts)
    assert (s.programs, s.streams, s.program, s.stream_type, s.faults) == (2, 3, 1, 6, 0)
    assert s.payload == b"first" and s.others == {0x101: b"second", 0x200: b"third"} and s.stamps == [90]


def test_media_odd(spark, odd):
    got = media.report(odd).collect()
    assert len(got) == odd.count()
    want = sorted(((t or "").encode() for t in (r["text"] for r in odd.collect())), key=lambda b: (len(b), b))
    pads = sorted((hashlib.sha256(media.padded(b)).hexdigest(), len(b), zlib.crc32(media.padded(b)[-64:])) for b in want)
    assert sorted((r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in got) == pads
    assert media.report(odd.filter("false")).count() == 0
    assert all(r["faults"] == 0 and [p["offset"] for p in r["points"]] == list(range(0, r["payload_bytes"], media.UNIT)) and [p["stamp"] for p in r["points"]] == r["stamps"] for r in got)
    parsed = media.with_parsed(media.with_media(odd.filter("doc_id = 1"))).first()["stream"]
    assert parsed["points"] == [0] and parsed["payload"].rstrip(b"\0").decode().startswith("One two")


# 4 and 9. Classifiers.


def accuracy(spark, name, label):
    data = DATA.replace("sf0.001", "sf0.1")
    rows = queries.QUERIES[name](spark, data).filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("predicted", F.col(label).alias("y"), "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    rate = lambda y: np.mean([r["predicted"] == y for r in rows if r["y"] == y])
    return rate(1), rate(0)


def test_quality_held_out(spark):
    good, bad = accuracy(spark, "op4_quality_classifier", "quality")
    assert good > 0.97 and bad > 0.9


def test_toxicity_held_out(spark):
    toxic, clean = accuracy(spark, "op9_toxicity", "toxic")
    assert toxic > 0.8 and clean > 0.98


@pytest.mark.parametrize("op,column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_odd(spark, odd, op, column):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    assert op.report(odd, labels).count() == odd.count()
    assert op.report(odd, labels.filter("false")).count() == odd.count()
    assert op.report(odd.filter("false"), labels).count() == 0
    rows = op.report(odd, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in rows)


def test_ratios_brute(spark):
    """Log-count ratios over all n-grams of small texts, and the texts' n-grams, from dictionaries of strings."""
    rows = [(1, "you idiot"), (1, "idiot!"), (1, "such an idiot"), (0, "a fine day"), (0, "you are fine"), (0, ""), (0, None), (0, "day by day")]
    sets = [(y, {t[i : i + n] for t in [f" {(t or '').lower()} "] for n in toxicity.SIZES for i in range(len(t) - n + 1)}) for y, t in rows]
    every = set().union(*(g for _, g in sets))
    p, q = ({g: sum(g in own for y, own in sets if y == side) for g in every} for side in (1, 0))
    sp, sq = sum(p.values()) + len(every), sum(q.values()) + len(every)
    df = spark.createDataFrame(rows, "toxic long, text string")
    counts = df.repartition(3).mapInArrow(toxicity._counts, "gram long, p long, q long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    grams, got = toxicity.ratios(counts, 3, 5, 0.0)
    hashes = {g: int(h[0]) for g in every for h in [[x for x in toxicity.gram_hashes(toxicity._chars(g)) if len(x)][-1]]}
    assert dict(zip(grams.tolist(), got.tolist())) == pytest.approx({hashes[g]: np.log((p[g] + 1) / sp) - np.log((q[g] + 1) / sq) for g in every})
    few, _ = toxicity.ratios(counts, 3, 5, 2.0)
    assert hashes["idiot"] in few.tolist() and hashes["day"] not in few.tolist() and len(few) < len(grams)


def test_risk_and_prior_brute():
    """The fit ends at a lower non-negative risk than it starts from, as a direct evaluation says; the prior is the least ratio of shares."""
    rng = np.random.default_rng(1)
    n = quality.N_FEATURES
    pos, un = rng.normal(1, 1, (200, n)), np.concatenate([rng.normal(1, 1, (150, n)), rng.normal(-1, 1, (150, n))])
    risk = lambda m: 0.5 * np.log1p(np.exp(-m.margin(pos))).mean() + max(0.0, np.log1p(np.exp(m.margin(un))).mean() - 0.5 * np.log1p(np.exp(m.margin(pos))).mean())
    start, end = quality.fit(pos, un, 0.5, steps=0), quality.fit(pos, un, 0.5)
    assert risk(end) < 0.2 < risk(start)
    a, b = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 1200), rng.normal(-2, 1, 2800)])
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(4000) + 1 / np.sqrt(4000))
    cuts = np.unique(np.quantile(a, np.linspace(0.0, 0.95, 96)))
    best = min(((sum(b >= c) / 4000 + slack) / (sum(a >= c) / 4000), sum(b >= c) / sum(a >= c)) for c in cuts)[1]
    assert quality.best_bin_prior(a, b) == pytest.approx(best) and 0.25 < best < 0.4


def test_fit_in_little_memory():
    """The fit holds its rows as doubles once, and what a step takes; their mean and scale are those of one array."""
    rng = np.random.default_rng(2)
    pos, un = (rng.normal(1, 2, (k, quality.N_FEATURES)).astype(np.float32) for k in (1500, 4000))
    both = np.concatenate([pos, un]).astype(np.float64)
    tracemalloc.start()
    m = quality.fit(pos, un, 0.5, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * both.nbytes
    assert (m.mean == both.mean(0)).all() and (m.scale == np.maximum(both.std(0), 1e-3)).all()


def test_whole_prior_brute(spark):
    """The prior counted over a table is that of the margins of all its texts in one array; a cap on the draw leaves it so."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc de.\n" if i % 3 else "|<>{} 0123")) for _ in range(int(rng.integers(0, 120)))) for i in range(900)]
    x = quality.features(*utf8(pa.array(texts))).astype(np.float64)
    good = np.array([i for i in range(900) if i % 3 and i % 2])
    for draw in (x[::4], x[::40]):
        first, held = quality.first_fit(x[good], draw)
        got = quality.whole_prior(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), first, held)
        assert got == pytest.approx(quality.best_bin_prior(held, first.margin(x))) and 0.5 < got < 0.8


def test_scores_at_the_threshold(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert quality.keep_good(df, labels, 0.5).count() == 2 and quality.keep_good(df, labels, 0.51).count() == 0
    assert {r["predicted"] for r in quality.report(df, labels, 0.5).collect()} == {1} and {r["predicted"] for r in toxicity.report(df, labels, 0.0).collect()} == {1}


def test_non_negative_risk_finds_negatives():
    rng = np.random.default_rng(0)
    pos = rng.normal(1, 1, (600, quality.N_FEATURES))
    un = np.concatenate([rng.normal(1, 1, (700, quality.N_FEATURES)), rng.normal(-1, 1, (300, quality.N_FEATURES))])
    first, held = quality.first_fit(pos, un)
    m = quality.fit(pos, un, quality.best_bin_prior(held, first.margin(un[1::2])))
    s = m.score(un)
    assert 0.6 < m.prior < 0.85 and (s[:700] > 0.5).mean() > 0.95 and (s[700:] < 0.5).mean() > 0.95


def test_features_ignore_neighbours():
    texts = ["Some Words here!", "", "a\nb\na\nb", "é é é"]
    whole = quality.features(*utf8(pa.array(texts)))
    each = np.concatenate([quality.features(*utf8(pa.array([t]))) for t in texts])
    assert np.allclose(whole, each)


# 5. Secrets.


def brute_spans(t):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.BASE.index(x[0])))


def test_scan_brute():
    rng = np.random.default_rng(1)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "漢", "\n", "ſecret", "-", "zz"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert [s for s in secrets.scan(t.encode()) if s[0] in secrets.BASE] == brute_spans(t)


def test_secret_odd(spark, odd):
    got = {r["doc_id"]: r for r in secrets.report(odd).collect()}
    assert secrets.report(odd).count() == odd.count() and secrets.report(odd.filter("false")).count() == 0
    t = odd.filter("doc_id = 7").first()["text"]
    assert got[7]["base_sha256"] == hashlib.sha256(secrets.joined(brute_spans(t)).encode()).hexdigest()
    assert (got[7]["n_assign"], got[7]["n_access"], got[7]["n_hex"]) == (2, 1, 1) and got[10]["n_assign"] == 0 and got[2]["spans"] == ""
    red = secrets.redact(odd)
    assert red.columns == odd.columns and red.count() == odd.count()
    assert red.filter("doc_id = 7").first()["text"] == 'é [assign]" [access] [assign]'


def test_ledger_is_incremental(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    one = spark.createDataFrame([("p", 1, "token=abcdefgh"), ("q", 1, "clean")], "path string, version int, text string")
    two = spark.createDataFrame([("p", 1, "token=abcdefgh"), ("p", 2, "token=zyxwvuts"), ("r", 1, "clean")], "path string, version int, text string")
    assert secrets.with_findings(one, ledger=ledger).filter("size(found) > 0").count() == 1
    assert ledger.rows().count() == 2
    found = secrets.with_findings(two, ledger=ledger).filter("size(found) > 0").select("path", "version").collect()
    assert sorted((r[0], r[1]) for r in found) == [("p", 1), ("p", 2)] and ledger.rows().count() == 3
    secrets.with_findings(two, ledger=ledger, rules="next").count()
    assert ledger.rows().count() == 6


# 6. Chat.


def test_escape_round_trips():
    rng = np.random.default_rng(2)
    parts = ["<", "[", "\\", "|turn|>", "|end|>", "s>", "/s>", "INST]", "/INST]", "\n", "a", "é", "<<SYS>>"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, int(rng.integers(0, 9))))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not re.search(r"[<\[]" + chat._TAILS, e)
        assert chat._unescape_role(chat._escape_role(t)) == t and "\n" not in chat._escape_role(t)


def test_chat_odd(spark):
    rows = [(1, 1, "user", None), (1, 0, "system", "<|end|>\n<|turn|>user\nhi"), (1, 2, "assistant", "é漢[INST]"), (2, None, None, ""), (2, None, "assistant", "b"), (None, 0, "assistant", "n"), (3, 0, "a\\b\n<s>", "x"), (3, 0, "a\\b\n<s>", "x"), (4, 0, "assistant", "long " * 300_000), (4, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        want = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == conv))
        want = [(ro, x) for _, _, ro, x in want]
        assert chat.read_turns(r["formatted"]) == want
        loss = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert loss == [x for ro, x in want if ro == "assistant"]
    assert chat.report(df.filter("false")).count() == 1


def test_chat_over_batches(spark):
    df = spark.range(500).selectExpr("id % 7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["conv_id"]: chat.read_turns(r["formatted"]) for r in chat.format_conversations(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {k: [t for _, t in v] for k, v in got.items()} == {k: [f"t{i}" for i in range(500) if i % 7 == k] for k in range(7)}


# 7. SimHash.


def test_index_is_exact():
    rng = np.random.default_rng(4)
    fps = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist())
    for x in list(fps)[:60]:
        for _ in range(20):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    f = np.array(sorted(fps), np.uint64)
    f = f[np.argsort(simhash.gray_rank(f))]
    group = np.sort(rng.integers(0, 3, len(f)))
    want = np.arange(len(f))
    for i in range(len(f)):
        j = np.flatnonzero((np.bitwise_count(f[i] ^ f) <= 3) & (group == group[i]))
        want = simhash._union(want, np.full(len(j), i), j)
    assert (simhash.GrayIndex(f, group).links(3) == want).all()


def brute_components(prints):
    ids, f = list(prints), np.array(list(prints.values()), np.uint64)
    label = np.arange(len(ids))
    for i in range(len(ids)):
        j = np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 3)
        label = simhash._union(label, np.full(len(j), i), j)
    least: dict = {}
    for i, x in zip(ids, label):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for i, x in zip(ids, label)}


@pytest.mark.parametrize("most", [simhash.MOST, 8])
def test_components_brute(spark, most):
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for g in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(40 if g == 0 else 6):
            y = x
            for b in rng.choice(64, int(rng.integers(0, 3)), replace=False):
                y ^= 1 << int(b)
            rows.append((i, y))
            i += 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(a, signed(b)) for a, b in rows], "id long, fp long")
    edges = simhash.links(df.select("fp").distinct(), most=most)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    own: dict = {}
    for a, b in rows:
        own.setdefault(roots.get(signed(b), signed(b)), []).append(a)
    got = {a: min(v) for v in own.values() for a in v}
    assert got == brute_components(dict(rows))


@pytest.mark.parametrize("few", [0, 20, simhash.FEW])
def test_components_of_long_paths(spark, few):
    """Paths in a random order of nodes, a star and loops; what is few goes through the driver, and no joins of rounds are left then."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(1000) - 500
    paths = [ids[at : at + n] for at, n in ((0, 300), (300, 2), (302, 90))]
    edges = [(int(a), int(b)) for p in paths for a, b in zip(p, p[1:])] + [(int(ids[400]), int(x)) for x in ids[401:450]] + [(int(x), int(x)) for x in ids[390:400]]
    out = simhash.components(spark.createDataFrame(edges, "a long, b long"), few=few)
    own: dict = {}
    for r in out.collect():
        own.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, own.values())) == sorted(sorted(map(int, p)) for p in (*paths, ids[400:450])) and all(r in v for r, v in own.items())
    assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == (few < simhash.FEW)
    assert simhash.components(spark.createDataFrame([(1, 1)], "a long, b long"), few=few).count() == 0


def test_fingerprint_brute(spark, odd):
    def brute(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        c = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        return sum(1 << b for b in range(64) if sh and 2 * c[b] > len(sh))

    rows = odd.filter("doc_id is null or doc_id not in (5, 8)").select("doc_id", "text")
    got = simhash.near_duplicates(rows).select("doc_id", simhash.hex64(F.col("fp")).alias("h"), "component_id").collect()
    want = sorted(f"{brute(r['text']):016x}" for r in rows.collect())
    assert sorted(r["h"] for r in got) == want
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[6] == of[1] == 1 and of[2] == of[3] == of[4] == 2 and of[None] is None
    assert simhash.near_duplicates(odd.filter("false")).count() == 0


@pytest.mark.parametrize("chunk", [None, 1])
def test_deduplicate_brute(spark, odd, chunk, monkeypatch):
    """chunk: families are split from this size on."""
    if chunk:
        monkeypatch.setattr(neardup, "LEAST_CHUNK", chunk)
    rng = np.random.default_rng(11)
    rows, i = [], 0
    for g in range(20):
        w = [f"v{x}" for x in rng.integers(0, 5000, 120)]
        for k in (0, 0, 1, 2, 12) if g else [int(x) for x in rng.integers(0, 6, 60)]:
            x = list(w)
            for p in rng.choice(120, k, replace=False):
                x[p] = f"n{rng.integers(0, 10**6)}"
            rows.append((i, " ".join(x)))
            i += 1
    sets = {a: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for a, t in rows}
    own = {a: a for a in sets}

    def find(a):
        while own[a] != a:
            a = own[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                own[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    assert {r["doc_id"] for r in neardup.deduplicate(df).collect()} == {a for a in own if find(a) == a}
    left = neardup.deduplicate(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 5, 7, 9, 10, None}
    assert neardup.deduplicate(odd.filter("false")).count() == 0


# 8. WARC.


def test_warc_odd(spark):
    big = "y" * 200
    rows = [(1, "http://a/", "short"), (2, "http://b/%20?x=\r\n", big), (3, None, big), (2, "http://b/", big), (4, "", None), (None, "u", big), (5, "http://c/", "short"), (6, "é", "<p>é漢</p>" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.report(df).collect())
    n = len(("<p>é漢</p>" * 20).encode())
    assert got == sorted([(1, 5, "response", None), (2, 200, "response", None), (2, 200, "response", None), (3, 200, "revisit", 2), (4, 0, "response", None), (0, 200, "revisit", 2), (5, 5, "response", None), (6, n, "response", None)], key=lambda x: (x[0], x[1]))
    nested = warc.captures(warc.read_records(warc.write_archives(df))).collect()
    assert all(r["request"] and r["main"] and r["metadata"] and r["request"]["concurrent_to"] == [r["main"]["id"]] == r["metadata"]["concurrent_to"] for r in nested)
    assert {r["main"]["payload"].decode() for r in nested if r["main"]["payload"] is not None} == {"short", big, "", "<p>é漢</p>" * 20}
    assert any(r["main"]["uri"] == "http://b/%20?x=\r\n" for r in nested)
    assert warc.report(df.filter("false")).count() == 0


def test_broken_archive():
    good = warc.record("response", "<a>", "u", b"HTTP/1.1 200 OK\r\n\r\nbody", "t")
    kinds = lambda x: [r["type"] for r in warc.parse(x)]
    assert kinds(good + good[:-10]) == ["response", "fault"] and kinds(b"junk") == ["fault"] and kinds(b"") == []
    for cut in range(1, len(good)):
        assert kinds(good[:-cut] + good)[-1] == "response" and kinds(good + good[:-cut] + good).count("response") >= 2
    assert kinds(good.replace(b"Content-Length: 23", b"Content-Length: x") + good) == ["fault", "response"]
    rng = np.random.default_rng(3)
    many = good * 6
    for _ in range(2000):
        b = bytearray(many)
        for at in rng.integers(0, len(b), int(rng.integers(1, 5))):
            b[at] = int(rng.integers(0, 256))
        assert sum(k != "fault" for k in kinds(bytes(b))) >= 1


def test_records_of_others(spark):
    two = warc.record("metadata", "<m>", "http://x/%25a%0A", b"k: v\r\n", "t").replace(b"Content-Type", b"WARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Type")
    main = [warc.record("response", f"<{c}>", "u", b"H\r\n\r\nbody", "t") for c in "ab"]
    big = warc.record("response", "<c>", "u", b"H\r\n\r\n" + b"z" * (6 << 20), "t")
    df = spark.createDataFrame([(b"".join([two, *main, b"noise", big]),), (None,), (b"",)], "archive binary")
    rows = warc.read_records(df).collect()
    assert [r["uri"] for r in rows if r["id"] == "<m>"] == ["http://x/%25a%0A"] and sum(r["type"] == "fault" for r in rows) == 1
    got = {r["capture"]: r for r in warc.captures(warc.read_records(df)).collect()}
    assert set(got) == {"<a>", "<b>", "<c>"} and got["<a>"]["metadata"]["id"] == got["<b>"]["metadata"]["id"] == "<m>"
    assert got["<c>"]["main"]["payload_bytes"] == 6 << 20


# 10. HTML.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First &eacute;&#233;&#x26;<br>line <i>in</i>line<p>Second
 para</p><form>Search <input></form><div id="comments"><p>Nice</p></div></article><aside>More</aside><footer>&copy; x</footer>"""


def test_extract():
    assert html.extract(PAGE, {}) == "Head & line First éé& line inline Second para"
    assert html.extract("", {}) == "" and html.extract("a < b <p>c", {}) == "a < b c" and html.extract("<p>open <b>x", {}) == "open x"
    assert html.extract("<table><tr><td>a<td>b</table>c", {}) == "a b c"


def test_style_tree_drops_templates(spark):
    rows = [(i, f"http://h/{i}", f"<body><div class='x1'><p>Welcome to the site</p></div><div class='x2'><p>Story number {i} is told here</p></div></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == {i: f"Story number {i} is told here" for i in range(60)}


def test_style_tree_keeps_what_stands_in_repeated_text(spark):
    rows = [(i, f"http://h/{i}", f"<body>Home | About<h1>Title {i}</h1><p>Only page {i} has this text</p></body>") for i in range(30)]
    rows += [(100 + i, "http://copies/", "<div><p>The same article in every copy</p></div>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Only page {i} has this text" for i in range(30)} | {100 + i: "The same article in every copy" for i in range(40)}


def test_words_of_classes_only_lower():
    for wrap in ("<div class='content-sidebar-wrap'><main>{}</main></div>", "<div class='layout has-sidebar'><article>{}</article></div>", "<div class='share-price'>{}</div>", "<form id='aspnet'>{}</form>"):
        assert html.extract(wrap.format("<h1>Head</h1><p>A story of some words</p>") + "<div class='sidebar'>Links</div>", {}) == "Head A story of some words"
    assert html.extract("<p>Now <span class='share'>Tweet</span> all of the rest</p><p>And more</p>", {}) == "Now all of the rest And more"


def test_importance_outweighs_words(spark):
    page = "<body><div class='related-work'><p>Story {0} with words of its own</p></div><div class='x'><p>Page {0} has a far longer text that outweighs by far what is in the other one</p></div><div class='ad'>Offer {0}</div></body>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == {i: f"Story {i} with words of its own Page {i} has a far longer text that outweighs by far what is in the other one" for i in range(30)}


def brute_standing(rows):
    """Standing of each (host, path) by recursion over the merged trees of a few pages."""
    import math

    nodes, texts, styles, hints = {}, {}, {}, {}
    for host, source in sorted({(html.host_of(u), h or "") for _, u, h in rows}):
        blocks, own = html.parse(source)
        for at in (host, "*"):
            per = {}
            for x in [*own, *{id(b.node): b.node for b in blocks}.values()]:
                if not x.noise:
                    nodes.setdefault((at, x.path), x.chain)
                    per.setdefault(x.path, []).append(x)
            for p, xs in per.items():
                styles.setdefault((at, p), []).append("|".join(",".join(x.children) for x in xs))
                hints.setdefault((at, p), []).append(max(x.hint for x in xs))
            for p, t in {(b.node.path, b.text.replace(host, "\0") if host else b.text) for b in blocks if not b.node.noise}:
                texts.setdefault((at, p), []).append(t)

    def own_importance(at, p):
        below = [t for (a, q), c in nodes.items() if a == at and p in c for t in [texts.get((a, q), [])]]
        every, once = sum(len(t) for ts in below for t in ts), sum(len(t) for ts in below for t in set(ts))
        content = once / every if every else 1.0
        s, m = styles[at, p], len(styles[at, p])
        if not any(x.strip("|") for x in s):
            return content
        entropy = -sum(s.count(x) / m * math.log(s.count(x) / m) for x in set(s)) / math.log(m) if m > 1 else 1.0
        return html.CONTENT_WEIGHT * content + (1 - html.CONTENT_WEIGHT) * entropy

    def importance(host, p):
        m, k = len(styles[host, p]), len(styles["*", p])
        wide = (own_importance("*", p) * k + sum(hints["*", p]) / k * html.HINT_PAGES) / (k + html.HINT_PAGES)
        return (own_importance(host, p) * m + wide * html.SITE_PAGES) / (m + html.SITE_PAGES)

    out = {}
    for (host, p), chain in nodes.items():
        if host != "*":
            v = importance(host, chain[0])
            for q in chain[1:]:
                v = html.OWN_SHARE * importance(host, q) + (1 - html.OWN_SHARE) * v
            out[host, p] = v
    return out


def test_style_tree_brute(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        menu = "".join(f"<li>go {x}</li>" for x in rng.integers(0, 4, 3))
        body = "".join(f"<p>{' '.join(f'w{x}' for x in rng.integers(0, 50, 8))}</p>" for _ in range(int(rng.integers(1, 4))))
        rows.append((i, f"http://h{i % 3}/", f"<body><div class='m'><ul>{menu}</ul>h{i % 3}</div><div class='ad'>Buy {i % 5}</div><section><h2>T{i}</h2>{body}<p>Again</p></section></body>"))
    rows += [rows[0], (99, None, None), (98, "http://h1/", "<div><div>")]
    got = {(r["host"], r["path"]): r["standing"] for r in html.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_standing(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_tree_decides_alone(spark, monkeypatch):
    """Without hints of tags or words the tree finds the articles; without the tree every page keeps its advert and its menu."""
    monkeypatch.setattr(html, "NOISE_WORDS", frozenset())
    monkeypatch.setattr(html, "NOISE", html.NOISE - {"nav", "footer", "aside"})
    pages = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/pages.parquet")
    text = {r["page_id"]: r["text"] for r in html.main_text(pages, hint_pages=0.0).collect()}
    found = bare = n = 0
    for r in pages.collect():
        article = html.extract(re.search("<article>.*</article>", r["html"], re.S)[0], {})
        n, found, bare = n + 1, found + (text[r["page_id"]] == article), bare + (html.extract(r["html"], {}) == article)
    assert found / n > 0.99 and bare == 0


def test_pages_keep_articles_only(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    text = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert all(text[r["page_id"]] == html.extract(re.search("<article>.*</article>", r["html"], re.S)[0], {}) for r in pages.collect())


def test_deep_and_long_pages():
    deep = html.extract("<div>" * 20_000 + "end", {})
    assert deep == "end" and len(html.extract("<p>" + "word " * 400_000, {})) == 1_999_999


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, None), (2, "http://h/", ""), (3, "http://h/", "<article>" + "long word " * 50_000), (3, "http://h/", "<p>x</p>"), (None, "u", "<p>漢</p>")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html.main_text(df).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 499_999)]
    assert html.main_text(df.filter("false")).count() == 0


# Columns that clash with the operators' own.


def test_columns_stay(spark, odd):
    """Operators that return the documents' columns return them as they were, whatever their names."""
    own = {c: F.lit(c) for c in ("__hits", "__spans", "__score", "__id", "__of", "__n", "__family", "__blob", "hits_", "spans", "no", "of", "blob", "family", "copy", "at", "target", "root")}
    docs = odd.withColumns(own).withColumn("a.b", F.lit(5))
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    for out in (decontam.decontaminate(docs, bench), secrets.redact(docs), quality.keep_good(docs, labels, 0.0), neardup.deduplicate(docs), mixing.emit(docs).drop("copy_")):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in own) and all(r["a.b"] == 5 and r["hits"] == "hits" and r["size"] == "size" for r in rows)


def test_deduplicate_is_stable(spark):
    df = spark.createDataFrame([(1, "same text of some words here", k) for k in range(50)], "doc_id long, text string, k int")
    assert {tuple(r) for _ in range(2) for r in neardup.deduplicate(df.repartition(3)).collect()} == {(1, "same text of some words here", 0)}


# The pipeline.


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = p.run(spark, DATA).collect()
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "mixture"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in out} <= set(texts) and not any(secrets.scan(r["text"].encode()) for r in out)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(b[i : i + 13]) for _, t in items for b in [lower_words(t)] for i in range(len(b) - 12)}
    for t in {r["text"] for r in out}:
        w = lower_words(t)
        assert not any(tuple(w[i : i + 13]) in windows for i in range(len(w) - 12))
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.filter("false"), DATA).columns == docs.columns


def test_stages_take_odd_rows(spark, odd):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert set(odd.columns) <= set(stage(spark, odd, DATA).columns)
        stage(spark, odd, DATA).count()
