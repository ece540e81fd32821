"""Operators on Spark against plain code: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lidarlake.llm import bpe, fingerprints, html_text, jaccard_join, langid, line_dedup, merkle, mixing, ogg, queries, resampling, signature_join, token_counts, warc
from lidarlake.llm.components import components
from tests.compare import compare, connect
from tests.llm import plain

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that bear names the operators use inside or return.
CLASH = ("row", "doc", "key", "lost", "id", "size", "words", "hub", "n_lines", "n_tokens", "ids", "score", "media", "fp", "f_words", "row_id", "kept", "node", "n", "tree", "leaf", "pos", "rank", "weight", "buckets")


def table_of(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH]) if clash else df


def odd_rows():
    """A small corpus with every odd case, near copies in groups and shared passages."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows, n = [], 100
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice((4, 6, 12, 40, 90, 400)))]
        for _ in range(rnd.choice((1, 2, 5, 9))):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            text = " ".join(w[: rnd.randrange(len(w) * 3 // 4, len(w)) + 1])
            text = text.replace(" w7", "\nThis line is in many places \n w7")
            rows.append((n, text if rnd.random() < 0.7 else passage + "\n" + text, "xx", f"s{g % 4}", len(text)))
            n += 1
    rows += [
        (1, None, "xx", "s0", None), (2, "", None, None, 0), (3, " \n\t ", "xx", "s1", 4), (4, "One two", "xx", None, 7),
        (5, "one TWO", "xx", "s2", 7), (None, "no id but\nA Line of Text here", "xx", "s1", 9), (6, "a line of text HERE \nx", None, "s9", 3),
        (7, rows[0][1], "xx", "s0", 1), (8, rows[0][1], "xx", "s0", 1), (8, rows[0][1], "xx", "s0", 1), (9, "123 !? 4", "xx", "s3", 8),
        (10, "wörter ÄÖÜ " * 3000, "xx", "s3", 1), (-5, "negative id here today yes", "xx", "s2", 1), (11, "x" * 50_000, "xx", "s2", 1),
        (12, rows[1][1], "xx", "s1", 2), (12, rows[9][1], "xx", "s1", 2),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def ordered(found):
    return sorted(found, key=repr)


def test_line_dedup(spark, rows):
    out = line_dedup.drop_repeated_lines(table_of(spark, rows)).collect()
    want = [(d, *x) for (d, _), x in zip(pairs(rows), plain.kept_lines(pairs(rows)))]
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == ordered(want)
    assert all(r["key"] == "own key" and r["lang"] in (None, "xx") for r in out)
    three = line_dedup.drop_repeated_lines(table_of(spark, [(i, "the same long line", None, None, 0) for i in (1, 2)]), min_docs=3)
    assert [r.n_dropped for r in three.collect()] == [0, 0]
    assert line_dedup.drop_repeated_lines(table_of(spark, [])).count() == 0


def check_components(spark, rows, **options):
    got = jaccard_join.similarity_components(table_of(spark, rows), **options).collect()
    want = [(d, *x) for (d, _), x in zip(pairs(rows), plain.linked_components(pairs(rows)))]
    assert ordered(map(tuple, got)) == ordered(want)


def test_jaccard_components(spark, rows):
    check_components(spark, rows)


def test_jaccard_components_with_short_sketches(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    assert jaccard_join.short_bands(np.arange(40, dtype=np.uint64) << np.uint64(50), 75, 30.0)
    check_components(spark, rows, fill=30.0)


def test_own_shingles_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 40)
    passage = " ".join(f"p{j}" for j in range(30))
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 7 * 5)) + " " + (passage if i % 3 else "")) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[1][1]), (63, rows[1][1]), (None, rows[4][1] + " end of it")]
    rows = [(i, t, None, None, None) for i, t in rows]
    sets, _, classes = jaccard_join._classes(table_of(spark, rows), "doc_id", "text", 5, 75, 2.2)
    texts = jaccard_join._rows(table_of(spark, rows), "doc_id", "text").repartition(5)
    distinct = {jaccard_join.shingle_set((t or "").encode()).tobytes() for _, t, *_ in rows} - {b""}
    holders = Counter(h for s in distinct for h in np.frombuffer(s, np.uint64).tolist())
    want = sorted(n for s in distinct if (n := sum(holders[h] == 1 for h in np.frombuffer(s, np.uint64).tolist())))
    found = {}
    for common in (jaccard_join.NOTHING, jaccard_join.common_shingles(sets)):
        own = jaccard_join.own_shingles(texts, classes, 5, common)
        assert sorted(r.own for r in own.collect()) == want
        found[len(common[0]) > 0] = {r.node: r.own for r in own.collect()}
    assert found[True] == found[False]
    live = {r.wanted: r.free for r in jaccard_join.live_classes(classes, own).collect()}
    sizes = {r.node: r.n for r in classes.collect()}
    assert live == {k: n - found[True].get(k, 0) for k, n in sizes.items() if (n - found[True].get(k, 0)) * 100 >= n * 75}


def test_two_holders_of_a_shingle_are_kept():
    h, w = jaccard_join._two_holders([np.array([5, 5, 5, 7, 9, 9], np.uint64)], [np.array([1, 2, 2, 4, 6, 6], np.int64)])
    assert list(zip(h.tolist(), w.tolist())) == [(5, 1), (5, 2), (7, 4), (9, 6)]
    assert jaccard_join._owners(h, w).to_pylist() == [{"node": 4, "own": 1}, {"node": 6, "own": 1}]


def test_jaccard_of_hot_words_and_chains(spark):
    """A chain of near copies whose ends are unlike, and groups that only share a passage."""
    rnd = random.Random(9)
    base = [f"c{i}" for i in range(80)]
    rows = []
    for k in range(40):
        rows.append((200 + k, " ".join(base), None, None, 0))
        base = base[6:] + [f"d{k}.{j}" for j in range(6)]
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(400 + k, passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(30)), None, None, 0) for k in range(60)]
    rnd.shuffle(rows)
    check_components(spark, rows)


def test_link_counts(spark, rows):
    """All links between rows, also those inside a component; rows of one doc_id are rows of their own."""
    sets = [jaccard_join.shingle_sets(jaccard_join.as_bytes(pa.array([r[1]], pa.string())), 5) for r in rows]
    sets = [set(next(iter(s)).tolist()) for s in sets]
    want = [(r[0], sum(100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets) if i != j and s and t)) for i, (r, s) in enumerate(zip(rows, sets))]
    got = jaccard_join.link_counts(table_of(spark, rows)).collect()
    assert ordered(map(tuple, got)) == ordered(want) and max(n for _, n in want) > 3


def test_components_of_any_graph(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, rows):
    docs = [(r[0], r[3], r[1]) for r in rows]
    want, parts = plain.mixed(docs)
    got = mixing.mixture(table_of(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert ordered((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == ordered(
        (d, s, n, total, round(t, 6), k) for (d, s, _), (n, total, t, k) in zip(docs, want)
    )
    for source in {d[1] for d in docs}:
        taken = sum(r.taken for r in got if r.source == source)
        target = next(r.target for r in got if r.source == source)
        assert abs(taken - target) <= 1 + len(want) / 50
    assert all(r.taken <= 3 * r.size for r in got)
    out = mixing.mixed_documents(table_of(spark, rows))
    texts = [(docs[i][0], plain.leading_words(docs[i][2], w) if w < want[i][0] else docs[i][2]) for i, _, w in parts]
    assert ordered((r.doc_id, r.text) for r in out.collect()) == ordered(texts)
    assert out.columns == table_of(spark, rows).columns
    assert mixing.mixture(table_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixture(table_of(spark, [(1, None, None, "a", 0)])).collect()] == [0]


def test_mixing_of_whole_documents(spark, rows):
    out = mixing.mixed_documents(table_of(spark, rows), whole=True).collect()
    given = {(r[0], r[1]) for r in rows}
    assert out and all((r.doc_id, r.text) in given for r in out)
    for texts in ((10, 10), (1, 40)):
        docs = [(1, "a " * texts[0], None, "s", 0), (2, "b " * texts[1], None, "t", 0)]
        targets = {r.source: r.target for r in mixing.mixture(table_of(spark, docs)).collect()}
        times = {s: sum(r.source == s for r in mixing.mixed_documents(table_of(spark, docs), whole=True).collect()) for s in "st"}
        assert all(abs(times[s] * n - targets[s]) <= n / 2 for s, n in zip("st", texts))


def test_mixing_shares_excess_again(spark):
    rows = [(i, "w " * 10, None, "a", 0) for i in range(3)] + [(10 + i, "w " * 10, None, "b", 0) for i in range(40)] + [(90, "w " * 7, None, None, 0)]
    got = {r.source: r for r in mixing.mixture(table_of(spark, rows)).collect()}
    assert got["a"].target == 90 and got[None].target == 21 and got["b"].target == 437 - 90 - 21


def test_fingerprints(spark, rows):
    usual = [r for r in rows if r[0] not in (8, 12)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table_of(spark, usual)).collect()}
    order = sorted(usual, key=lambda r: float("inf") if r[0] is None else -r[0])
    for k, r in enumerate(order):
        text, after, out = r[1] or "", order[(k + 1) % len(order)][1] or "", got[r[0]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out.n_chars == len(text) and out.edited_sha256 == plain.sha(edited)
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = (plain.shingles(t.lower()) for t in (text, other))
            true = len(a & b) / len(a | b) if a or b else 1.0
            assert 0 <= out[name] <= 1 and abs(out[name] - true) < 0.15
    same = [r.fingerprint for r in got.values() if r.doc_id in (100, 7)]
    assert len(set(same)) == 1 and got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == ""
    assert len(got[10].fingerprint) == fingerprints.BINS * fingerprints.BITS // 4


def test_fingerprints_of_repeats_and_few_rows(spark, rows, monkeypatch):
    assert fingerprints.edited_fingerprints(table_of(spark, [])).count() == 0
    one = fingerprints.edited_fingerprints(table_of(spark, [(3, "abcd efgh", None, None, 0)])).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(9, plain.sha("abcd abcd"[:5] + "abcd"))]
    none = fingerprints.edited_fingerprints(table_of(spark, [(None, "ab", None, None, 0), (None, "cd", None, None, 0)])).collect()
    assert sorted(r.edited_sha256 for r in none) == sorted([plain.sha("ac"), plain.sha("ca")])
    monkeypatch.setattr(fingerprints, "ROWS_PER_CHUNK", 4)
    usual = [(i * i, f"text {i} " * 9, None, None, 0) for i in range(60)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(table_of(spark, usual)).collect()}
    for k, r in enumerate(usual):
        text, after = r[1], usual[k - 1][1]
        assert got[r[0]] == plain.sha(text[: len(text) - len(text) // 2] + after[: len(text) // 2])
    assert fingerprints.edited_fingerprints(table_of(spark, rows)).count() == len(rows)


def test_fingerprint_plan_is_native(spark):
    plan = queries.QUERIES["op1_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Scan ExistingRDD"))


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op2_langid"](spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and len(r.text) > 100]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark, rows):
    df = table_of(spark, rows)
    out = langid.predict_language(df, langid.labelled_sample(df)).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out} == {"xx", "und"}
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in out)
    assert all(r["row"] == "own row" for r in out)
    empty = table_of(spark, [])
    assert langid.labelled_sample(empty) == {} and langid.predict_language(empty, {}).count() == 0
    assert [r.lang_pred for r in langid.predict_language(df, {}).collect()] == ["und"] * len(rows)


def test_media(spark, rows):
    out = ogg.read_media(ogg.store_text(table_of(spark, rows)), with_payload=True).collect()
    want = {}
    for d, t in pairs(rows):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) if b else bytes(64)
        want.setdefault(d, []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        assert r.error is None and len(r.payload) == r.payload_bytes and r["row"] == "own row"
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    broken = spark.createDataFrame([(1, b"OggS nothing"), (2, None)], "k long, media binary")
    assert [r.payload_bytes for r in ogg.read_media(broken).collect()] == [None, None]
    assert ogg.read_media(ogg.store_text(table_of(spark, []))).count() == 0


def test_encoding_and_counts(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.encoded_digests(table_of(spark, rows), path).collect()
    want = []
    for d, t in pairs(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), plain.sha(library.decode(ids, skip_special_tokens=False))))
    assert ordered(map(tuple, got)) == ordered(want)
    kept = bpe.decode(bpe.encode(table_of(spark, rows), path), path)
    assert kept.columns[-1] == "decoded" and kept.first()["row"] == "own row"
    assert ordered((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), plain.sha(r.decoded)) for r in kept.collect()) == ordered(want)
    assert bpe.encode(kept.select("text"), path).count() == len(rows)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(table_of(spark, rows), path).collect()
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in pairs(rows)]
    assert ordered(map(tuple, got)) == ordered((d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(pairs(rows), n))
    assert token_counts.count_tokens(table_of(spark, []), path).count() == 0


def test_pages(spark):
    rows = [(1, "http://a/", "<p>One, two.</p>"), (2, None, None), (2, None, None), (None, "u", ""), (3, "http://b/", "<nav>x</nav>"), (4, "v", "<p> </p>" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("row", F.lit("own"))
    out = html_text.extract_main_text(df).collect()
    assert ordered((r.page_id, r.text, r.n_chars) for r in out) == ordered([(1, "One, two.", 9), (2, "", 0), (2, "", 0), (None, "", 0), (3, "", 0), (4, "", 0)])
    out = warc.derivatives(warc.page_responses(df)).collect()
    assert len(out) == 2 * len(rows) and not any(r.error for r in out)
    by_id = {(r.page_id, r.record_type): r for r in out}
    assert by_id[1, "metadata"].refers_to == by_id[1, "conversion"].refers_to and by_id[2, "conversion"].target_uri is None
    assert by_id[1, "conversion"].source_payload_digest == warc.digest(b"<p>One, two.</p>")
    assert [r.error is None for r in warc.derivatives(spark.createDataFrame([(1, b"bad"), (2, None)], "page_id long, record binary")).collect()] == [False, False]
    assert warc.derivatives(warc.page_responses(df.limit(0))).count() == 0 and html_text.extract_main_text(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    import gzip

    records = [warc.response(f"http://e/{i}", b"<p>%d" % i, str(i)) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[2:])))
    got = warc.read_warc(spark, str(tmp_path))
    assert sorted(bytes(r.record) for r in got.collect()) == sorted(records)
    out = warc.derivatives(got.withColumnRenamed("place", "page_id"))
    assert out.count() == 10 and out.where("error is not null").count() == 0


def whole_mix(docs, repeats=3):
    """Like plain.mixed, but each source's entry at its target is taken or left as a whole, up to the budget."""
    per, entries, parts, used = plain.mixed(docs)[0], [], [], 0
    for s in {d[1] for d in docs}:
        keys = {i: hashlib.md5(("" if d[0] is None else str(d[0])).encode()).hexdigest() for i, d in enumerate(docs) if d[1] == s}
        stop = 0
        for copy in range(repeats):
            for i in sorted(keys, key=keys.get):
                start, stop = stop, stop + per[i][0]
                if per[i][2] and stop - per[i][2] <= per[i][2] - start:
                    entries.append((stop / per[i][2], keys[i], docs[i][0] or 0, per[i][0], copy, i))
    for *_, words, copy, i in sorted(entries):
        if used >= sum(n for n, *_ in per):
            break
        used += words
        if words:
            parts.append((i, copy, words))
    return per, parts


def plain_pipeline(docs):
    """The rows of the pipeline by plain code; docs: (doc_id, text, lang, source)."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [d for d in docs if d[1] and any(map(str.isalpha, d[1]))]
    docs = [(d[0], kept, d[3]) for d, (_, _, kept) in zip(docs, plain.kept_lines([d[:2] for d in docs]))]
    groups = plain.linked_components([d[:2] for d in docs])
    docs = [d for d, (_, c) in zip(docs, groups) if d[0] == c]
    out = []
    for i, *_ in whole_mix([(d, s, t) for d, t, s in docs])[1]:
        text = docs[i][1]
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        out.append((docs[i][0], docs[i][2], len(ids), raw, hashlib.sha256(raw).hexdigest(), plain.sha(library.decode(ids, skip_special_tokens=False))))
    return out


def run_stages(spark, df, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = df.columns
        df = stage(spark, df, None)
        assert k == len(corpus_pipeline.STAGES) - 1 or df.columns == columns
        df.write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
    return df


def test_pipeline(spark, rows, tmp_path):
    used = [r for r in rows if r[0] not in (8, 12)]
    got = run_stages(spark, table_of(spark, used), tmp_path).collect()
    want = plain_pipeline([(r[0], r[1], r[2], r[3]) for r in used])
    assert ordered((*r[:3], bytes(r[3]), *r[4:]) for r in map(tuple, got)) == ordered(want)


def test_pipeline_mixes_whole_documents(spark, rows):
    used = [r for r in rows if r[0] not in (8, 12, None)]
    docs = [(r[0], r[3], r[1]) for r in used]
    _, parts = whole_mix(docs)
    got = corpus_pipeline.source_mix(spark, table_of(spark, used), None).select("doc_id", "text").collect()
    assert ordered(map(tuple, got)) == ordered((docs[i][0], docs[i][2]) for i, *_ in parts)


def test_pipeline_of_repeats_and_nothing(spark, rows, tmp_path):
    assert run_stages(spark, table_of(spark, rows), tmp_path / "a").count() > 0
    assert run_stages(spark, table_of(spark, []), tmp_path / "b").count() == 0


def test_near_duplicates(spark, rows):
    """Components at 0.85 by plain code: nulls, repeats, rows that share an id, groups of near copies, shared passages."""
    got = signature_join.near_duplicates(table_of(spark, rows)).collect()
    want = [(d, *x) for (d, _), x in zip(pairs(rows), plain.linked_components(pairs(rows), 85))]
    assert ordered(map(tuple, got)) == ordered((d, n, c, d == c) for d, n, c in want)
    assert signature_join.near_duplicates(table_of(spark, [])).count() == 0


def test_near_duplicates_beyond_the_hub(spark):
    """Chains, copies far from the text they come from but near each other, and a passage in many texts."""
    rnd = random.Random(21)
    base = [f"c{i}" for i in range(120)]
    rows = [(1, " ".join(base), None, None, 0)]
    for k in range(30):  # edits of the base, some too many for a link, in pairs that share their edits
        w = list(base)
        for i in rnd.sample(range(120), rnd.choice((1, 2, 5, 9))):
            w[i] = f"e{k}.{i}"
        rows.append((10 + 2 * k, " ".join(w), None, None, 0))
        w[rnd.randrange(120)] = f"x{k}"
        rows.append((11 + 2 * k, " ".join(w), None, None, 0))
    for k in range(25):
        rows.append((200 + k, " ".join(base), None, None, 0))
        base = base[4:] + [f"d{k}.{j}" for j in range(4)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(400 + k, passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(30)), None, None, 0) for k in range(40)]
    got = signature_join.near_duplicates(table_of(spark, rows)).collect()
    want = plain.linked_components(pairs(rows), 85)
    assert ordered((r.doc_id, r.component_id) for r in got) == ordered((r[0], c) for r, (_, c) in zip(rows, want))
    assert len({c for _, c in want}) > 45


def test_signature_agreement():
    """Coordinates agree as often as the sets are similar."""
    rng = np.random.default_rng(1)
    both, own = rng.integers(0, 2**63, 1700, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = (signature_join.signature(np.sort(np.concatenate([both, o]))) for o in (own[:150], own[150:]))
    assert abs((a == b).mean() - 0.85) < 0.14 and (a == signature_join.signature(both[:50])).mean() < 0.2


def plain_draw(docs, target, least=20, percent=25):
    """Rows of the resampling by plain code."""
    split = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def buckets(text):
        w = split.findall((text or "").translate(plain.LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own, aim = [buckets(t) for _, t in docs], [buckets(t) for t in target]
    s, t = (Counter(b for _, f in part for b in f) for part in (own, aim))
    size = [sum(c.values()) for c in (s, t)]
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (size[0] + 10000) / ((s[b] + 1) * (size[1] + 10000)))) for b in s}
    out = []
    for (d, _), (n, f) in zip(docs, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {}
    for i, r in enumerate(may[: len(may) * percent // 100]):
        rank.setdefault(r, []).append(i + 1)
    return [(r[0], *r[2:], rank[r].pop(0) if rank.get(r) else None) for r in out]


def test_resampling(spark, rows, monkeypatch):
    target = [rows[0][1], None, "", "One two 3 four ÄÖ", rows[20][1]]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = ordered(plain_draw(pairs(rows), target))
    assert ordered(map(tuple, resampling.resample(table_of(spark, rows), aim).collect())) == want
    assert sum(r[-1] is not None for r in want) > 5
    assert resampling.resample(table_of(spark, []), aim).count() == 0
    nothing = resampling.resample(table_of(spark, rows), aim.limit(0)).collect()
    assert ordered(map(tuple, nothing)) == ordered(plain_draw(pairs(rows), []))


def test_resampling_of_long_texts(monkeypatch):
    """A text cut into blocks has the same features as a whole one."""
    rnd = random.Random(3)
    text = " ".join(rnd.choice(("a", "Bé", "c-d", "x" * 60, "9.5", "--")) for _ in range(3000)).encode()
    split = resampling.splitter()
    many, _, whole = resampling.window_buckets([text], split)
    from lidarlake.llm import common

    monkeypatch.setattr(common, "BLOCK_CHARS", 500)
    n, parts = resampling._long_text(text, split, resampling.BUCKETS, 2)
    assert n == many[0] and sorted(parts.tolist()) == sorted(whole.tolist()) and n > 3000


def plain_manifest(rows, tampered):
    """(leaf, subroot, root, proof, folded root, verified) per row by plain code; rows: doc_id, source, lang, n_chars, text."""
    def leaf(r):
        return plain.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([plain.sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(tree, at, h):
        seen = ""
        for nodes in tree[:-1]:
            run, k = nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8
            seen, h, at = seen + "".join(run[:k] + run[k + 1 :]), plain.sha("".join(run[:k] + [h] + run[k + 1 :])), at // 8
        return seen, h

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]]) for g in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            inner, h = climb(trees[k], i, leaf(tampered(r)))
            outer, h = climb(top, k, h)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], plain.sha(inner + outer), h, h == top[-1][0]))
    return out


def lowered(r):
    if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 3:
        return r
    return (*r[:4], r[4].translate(plain.LOWER))


@pytest.mark.parametrize("lane", [4096, 8, 16])
def test_manifest(spark, rows, monkeypatch, lane):
    monkeypatch.setattr(merkle, "LANE", lane)
    many = rows + [(1000 + i, f"Text {i}", (None, "yy", f"l{i % 11}")[i % 3], "s", i) for i in range(150 if lane == 8 else 20)]
    got = merkle.tamper_check(table_of(spark, many)).collect()
    want = plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in many], lowered)
    assert ordered(map(tuple, got)) == ordered(want) and {r[-1] for r in want} == {True, False}


def test_manifest_of_one_and_none(spark):
    for rows in ([(3, "A", None, "s", 1)], [(3, "A", "x", None, None), (4, None, "y", "s", 0)], []):
        got = merkle.tamper_check(table_of(spark, rows)).collect()
        assert ordered(map(tuple, got)) == ordered(plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows], lowered) if rows else [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    diff, n = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert diff is None and n > 0


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
