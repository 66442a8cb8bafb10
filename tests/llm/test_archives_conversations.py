"""Resampling, archives and conversation repair against brute force, on tables of awkward cases."""

import base64
import hashlib
import heapq
import math
import random
import re
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from messy import docs, rows, some

from robustlake.llm import archives, conversations, resampling
from robustlake.llm.archives import OP12_SQL, _Bytes, arc_records, op12_warc, read_warc, write_arc
from robustlake.llm.conversations import Automaton, op13_repair, repair
from robustlake.llm.resampling import BUCKETS, op11_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=some)


# --- resampling ----------------------------------------------------------------


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % BUCKETS


def resampled(own, target):
    counts = []
    for texts in ([r[1] for r in own], target):
        n = [0] * BUCKETS
        for t in texts:
            for f in features(t)[1]:
                n[bucket(f)] += 1
        counts.append(n)
    s, t = counts
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for doc_id, text, *_ in own:
        w, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    pool = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(pool[: 5 * len(pool) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=some)


def test_resampling_equals_brute_force(spark):
    own = rows()
    own += [(1000 + i, f"{r[1]} more {i}", "en", "s", 1, 1.0, "r", 1) for i, r in enumerate(own[:12] * 8)]  # a draw of several
    target = [" ".join(own[0][1].split()[:30]), None, "", own[5][1]]
    got = found(op11_resample(docs(spark, own), spark.createDataFrame([(i, t, 3) for i, t in enumerate(target)], "item_id long, text string, doc_id long")))
    assert got == resampled(own, target)
    assert max(r[4] or 0 for r in got) > 3


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert op11_resample(docs(spark, []).limit(0), empty).count() == 0
    assert found(op11_resample(docs(spark), empty)) == resampled(rows(), [])


@pytest.mark.parametrize(("words", "part"), [(3, 40), (5, 1000), (1000, 40)])
def test_blocks_of_a_text_give_what_the_whole_text_gives(monkeypatch, words, part):
    monkeypatch.setattr(resampling, "BLOCK_WORDS", words)
    monkeypatch.setattr(resampling, "PART_BYTES", part)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["Ab", "c", "été", "x" * 70, "y" * 64, "z" * 63, "q1"]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", "one", "a" * 300]
    expected = np.zeros(BUCKETS, np.int64)
    for t in texts:
        for f in features(t)[1]:
            expected[bucket(f)] += 1
    raw = [t.encode() for t in texts]
    assert (resampling.bucket_counts(raw) == expected).all()
    gains = np.random.default_rng(0).integers(-(2**40), 2**40, BUCKETS)
    n_words, sums = resampling.weights(raw, gains)
    assert [(int(a), int(b)) for a, b in zip(n_words, sums)] == [(len(features(t)[0]), sum(int(gains[bucket(f)]) for f in features(t)[1])) for t in texts]


# --- archives --------------------------------------------------------------------

PAGES = "page_id long, url string, html string, size long, digest string, place long"


def page_rows():
    rng = random.Random(5)
    out = [(i, f"http://x{i % 3}.org/a b?{i}", "<p>" + "é word " * rng.randrange(40) + str(i % 4) + "</p>", 1, "d", 2) for i in range(40)]
    copies = [(100 + i, None, "<html>same\r\n\r\nWARC/1.0\r\n</html>", 0, None, None) for i in range(30)]
    tricky = ["", None, "\n", "\r\n\r\n", "http://y 0.0.0.0 20000101000000 text/html 5\nabc", "filedesc://z 0.0.0.0 1 t 9\n1 0 x", "HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\nx", "x" * 3_000_000, "\x00\x01"]
    out += copies + [(200 + i, "u\n\tv", t, None, None, None) for i, t in enumerate(tricky)]
    return [*out, (None, None, None, 1, "", 1), (None, "n", "alone", 1, "", 1), copies[3], copies[29], copies[29], out[2], out[2]]


def archived(own):
    body = lambda r: (r[2] or "").encode()
    groups = {}
    for r in own:
        groups.setdefault(body(r), []).append(r[0])
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, -(x or 0)))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(x, len(payload), digest, "revisit" if k else "response", ids[0] if k else None) for k, x in enumerate(ids)]
    return sorted(out, key=some)


@pytest.mark.parametrize("records", [4096, 7])
def test_pages_through_archives_equal_brute_force(spark, monkeypatch, records):
    monkeypatch.setattr(archives, "RECORDS", records)
    got = op12_warc(spark.createDataFrame(page_rows(), PAGES).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert found(got) == archived(page_rows())


def test_small_payloads_are_stored_each(spark):
    kinds = {r[0]: r[3] for r in found(op12_warc(spark.createDataFrame(page_rows(), PAGES), least=10)) if r[0] is not None and r[0] < 100 or r[1] < 10}
    assert kinds[200] == "response" and kinds[201] == "response"


def test_archives_of_no_pages(spark):
    assert op12_warc(spark.createDataFrame([], PAGES)).count() == 0


def test_sql_of_archives(spark, tmp_path):
    pages = spark.createDataFrame([r for r in page_rows() if r[0] is not None and r[0] != 203], PAGES).dropDuplicates(["page_id"])
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert found(op12_warc(pages)) == sorted(duckdb.sql(OP12_SQL).fetchall(), key=some)


def test_files_have_both_versions_and_warc_fields(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "RECORDS", 5)
    write_arc(spark.createDataFrame(page_rows(), PAGES).coalesce(1), f"file://{tmp_path}/arc")
    versions = [v for p in sorted((tmp_path / "arc").glob("part-*")) for v, *_ in arc_records(_Bytes(p.name, p.read_bytes()))]
    assert len(versions) == len(page_rows()) and set(versions) == {1, 2}
    archives.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    rows_back = read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert all(uuid.UUID(r["id"].removeprefix("urn:uuid:")) and r["date"] == "2000-01-01T00:00:00Z" for r in rows_back)
    assert len({r["id"] for r in rows_back}) == len(page_rows())
    assert {r["url"] for r in rows_back} >= {"-", "u%0A%09v", "http://x0.org/a%20b?0"}
    assert sorted(r["payload"].decode() for r in rows_back if r["kind"] == "response") == sorted({r[2] or "" for r in page_rows()})


def test_broken_archives_name_the_place():
    good = archives._version_block(1, "a") + b"\n" + archives._arc_line(1, b"u", 3, 200, "-", 0, "a") + b"abc\n"
    assert [r[3] for r in arc_records(_Bytes("f", good))] == [b"abc"]
    for bad in (good[:-3], good.replace(b" 3\n", b" 2\n"), good.replace(b" 3\n", b" x\n"), good.replace(b"1 0 c", b"3 0 c"), b"no" + good, good + b"trailing"):
        with pytest.raises(ValueError, match="f at byte"):
            list(arc_records(_Bytes("f", bad)))


# --- conversations ---------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, copies long, cost long, part int"


def turn_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No", "What is it?", " \t", "", "Stop!  ", "a\nb.", None, "?", "é"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    out = []
    for conv in range(120):
        shape = rng.random()
        for turn in range(rng.randrange(0, 9)):
            role = roles[rng.randrange(len(roles))] if shape < 0.5 else ("user", "assistant")[turn % 2]
            out.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, rng.choice(texts) if shape < 0.7 else f"t{turn}.", 1, 2, 3))
    out += [(None, 0, "user", "hello.", 0, 0, 0), (None, None, "assistant", "again", 0, 0, 0)]
    out += [(500, i, ("user", "assistant")[i % 2], f"long {i}" + "." * (i % 3), 0, 0, 0) for i in range(400)]
    out += [(501, None, "user", "same.", 0, 0, 0)] * 50 + [(501, 3, "assistant", "same.", 0, 0, 0)] * 30
    return out


def edited(rows):
    """Cheapest edits by best-first search over (row, state); audits compared as they grow."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    heap, done = [(0, "", 0, 0, "")], set()
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        name = {2: "user", 3: "assistant"}[nxt[q]]
        steps = [("I", 2, i, nxt[q], [f"{name}:"])]
        if i < len(rows):
            role, text, fault = rows[i]
            late = fault == "truncated"
            steps.append(("D", 3, i + 1, q, []))
            if fault not in ("blank", "duplicate"):
                steps.append(("R", 2 + late, i + 1, nxt[q], [f"{name}:{text}"]))
                if role[:1] == name[0]:
                    steps.append(("K", late, i + 1, nxt[q], [f"{role}:{text}"]))
                if role[:1] == "s" and q == 0:
                    steps.append(("K", late, i + 1, 1, [f"{role}:{text}"]))
        for letter, c, j, to, new in steps:
            heapq.heappush(heap, (cost + c, audit + letter, j, to, "\n".join(([out] if audit.strip("D") else []) + new)))


def mended(own):
    convs = {}
    for conv, turn, role, text, *_ in own:
        rows_ = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        rows_ += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows_ in convs.items():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in rows_:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[0] for r in rows_} - {None}
        cost, audit, text = edited(faulty)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:]))
        n = [sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=some)


@pytest.mark.parametrize("rows_of_segment", [4096, 3, 1])
def test_repair_equals_search(spark, monkeypatch, rows_of_segment):
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", rows_of_segment)
    own = turn_rows()
    random.Random(2).shuffle(own)
    got = op13_repair(spark.createDataFrame(own, TURNS).repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(got) == mended(own)


def test_repair_of_no_conversations(spark):
    assert op13_repair(spark.createDataFrame([], TURNS)).count() == 0


def test_a_conversation_of_most_rows_is_cut_and_counted(spark):
    own = [(7, i, "user", f"line {i}.", 0, 0, 0) for i in range(30_000)] + [(8, 1, "user", "same.", 0, 0, 0)] * 20_000
    got = {r["conv_id"]: r for r in op13_repair(spark.createDataFrame(own, TURNS)).collect()}
    copies = [r for r in own if r[0] == 8]
    assert got[8]["duplicate"] >= len(copies) - 1 and got[8]["cost"] == mended(copies)[0][6]
    assert set(got[7]["audit"]) <= set("DKRI") and len(got[7]["audit"]) >= 28_000


def test_the_automaton_has_few_states():
    a, rng = Automaton(), random.Random(0)
    state = a.end
    for _ in range(20_000):
        state, _ = a.step(state, rng.randrange(9))
    assert len(a.vectors) < 60


def test_counts_of_copies_equal_copies(spark):
    rows_ = [(1, t, r, x, n) for t, r, x, n in [(0, "user", "a.", 3), (1, "assistant", "b", 2), (1, "assistant", "c", 0), (2, "user", "a.", 4)]]
    schema = "conv_id long, turn long, role string, text string, copies long"
    each = [(c, t, r, x, 1) for c, t, r, x, n in rows_ for _ in range(n)]
    assert found(repair(spark.createDataFrame(rows_, schema))) == found(repair(spark.createDataFrame(each, schema)))


def through_sql(tmp_path, sql, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return sorted(duckdb.sql(sql).fetchall(), key=some)


def test_sql_of_resampling(spark, tmp_path):
    own = docs(spark, rows() + [(1000 + i, f"{r[1]} more {i}", "en", "s", 1, 1.0, "r", 1) for i, r in enumerate(rows()[:12] * 8)])
    target = spark.createDataFrame([(0, rows()[0][1]), (1, None)], "item_id long, text string")
    assert through_sql(tmp_path, resampling.OP11_SQL, documents=own, benchmark=target) == found(op11_resample(own, target))


def test_sql_of_repair(spark, tmp_path):
    own = spark.createDataFrame([r for r in turn_rows() if r[0] != 500], TURNS)
    assert through_sql(tmp_path, conversations.OP13_SQL, conversations=own) == found(op13_repair(own))
