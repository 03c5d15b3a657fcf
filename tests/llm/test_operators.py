"""The ten operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskloom.llm import bpe, common, contamination, jaccard, katz, lines, neighbours, packing, quality, records, substrings, toxicity
from maskloom.llm.components import components
from maskloom.llm.fitting import isotonic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASH = ("key", "row", "n", "starts", "score", "held_out", "gone", "task")
_rng = random.Random(4)
VOCABULARY = ["".join(_rng.choices("abcdefgh", k=4)) for _ in range(60)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def corpus():
    """(doc_id, text, source): copies, near copies, shared passages and lines, nulls, empties, a long text."""
    passage, base = prose(40, "passage"), prose(120, "base").split()
    rows = [(i, prose(30 + i % 50, i), f"s{i % 7}") for i in range(40)]
    rows += [(100 + i, " ".join(base[: 3 * i] + ["changed"] + base[3 * i + 1 :]), f"s{i % 5}") for i in range(12)]
    rows += [(200 + i, " ".join(base), f"s{i % 9}") for i in range(6)]
    rows += [(300 + i, prose(20, f"a{i}") + "\n" + passage + "\nCommon footer line.\n" + prose(9, f"b{i}"), f"s{i}") for i in range(14)]
    rows += [(400, None, "s1"), (401, "", None), (402, " \n\t ", "s2"), (403, "one two", "s3"), (404, "ONE two", "s4"), (405, prose(9000, "long"), "s0"), (406, "Ünï 😀 code\x85x", None)]
    rows += [(None, prose(25, "null"), "s1"), (7, prose(37, 7), "s0"), (7, prose(37, 7), "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t) if t else None) for i, t, s in corpus()]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text, lower=True):
    raw = (text or "").encode()
    if lower:
        raw = raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


# --- 1 ---


def test_lines_match_sql(spark, docs):
    rows = [(i, t, s) for i, t, s in corpus() if i is not None and i != 7]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = lines.dedup_lines(df, min_sites=8).select("doc_id", "text", "lines_removed").toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(lines.oracle(8)).df()
    key = lambda f: sorted((int(r.doc_id), None if r.text is None or r.text != r.text else r.text, int(r.lines_removed)) for r in f.itertuples())
    assert key(got) == key(want)
    assert got["lines_removed"].sum() == 26  # two lines in 14 documents, each staying once


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(i, "Footer line\nown " + str(i), "en", f"s{i}", 0) for i in range(9)]
    rows += [(50, "Footer line\nzz", "en", "s1", 0), (50, "another real sentence\nyy", "en", "s1", 0), (None, "real one\nFooter line", "en", "s2", 0), (None, "real two\nreal three", "en", "s2", 0), (51, "Footer line", "en", "s", 0), (51, "Footer line", "en", "s", 0), (52, "x\n" * 30_000 + "Footer line", "en", "s", 0)]
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS), min_sites=8).collect()}
    # the null id is first, so its footer is the one that stays
    want = {*((i, f"own {i}") for i in range(9)), (50, "zz"), (50, "another real sentence\nyy"), (None, "real one\nFooter line"), (None, "real two\nreal three"), (51, ""), (52, "x\n" * 29_999 + "x")}
    assert got == want


def test_lines_keep_rows_and_columns(docs, empty):
    out = lines.dedup_lines(docs, min_sites=8)
    assert out.columns == [*docs.columns, "lines_removed"]
    assert out.count() == docs.count()
    assert out.where("doc_id = 400").first()["text"] is None
    assert lines.dedup_lines(empty).count() == 0


# --- 2 and 8 ---


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_ids_are_the_tokenizers(name):
    path = public_tokenizers.path(name)
    whole, encode = Tokenizer.from_file(path), bpe.ChunkEncoder(path)
    odd = ["", " ", "  ", " a", "a ", "a  b", "a\n\nb", "\n a", "a,b. c.\nD", "don't I'LL <|endoftext|> x", "ΑΣ ΟΔΟΣ ς", "日本語 テキスト", "é é İx", "x\x85y\x1cz", "1234 ab12,,;;", "😀 👍🏽", "a\tb \tc", "“q” t", "\x01 \x01a"]
    texts = [*odd, *(t or "" for _, t, _ in corpus())]
    for _ in range(2):  # cold and warm cache
        ids, counts = encode.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_strings_are_the_tokenizers(name, monkeypatch):
    """Strings of blanks of all kinds, controls, marks, scripts and special tokens; the table starts anew now and then."""
    monkeypatch.setattr(bpe, "CHUNKS", 3000)
    encode, rng = bpe.ChunkEncoder(public_tokenizers.path(name)), random.Random(8)
    assert encode.by_model
    parts = [*"aBzéÉ×÷İıßŉſЖйΣς1²½٣ \n\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2003\u2009\u200b\u2028\u3000.,!';-_$|<#́̇中日한ﬁÅ😀\ufeff\x00\x7f", "'s", "'ll", "n't", "the", " and", "<|endoftext|>", "<|startoftext|>", "<|", "é", "가"]
    for _ in range(12):
        texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000)]
        ids, counts = encode.encode(pa.array(texts))
        want, sizes = encode.direct(texts)
        assert counts.tolist() == sizes.tolist()
        assert ids.tolist() == want.tolist()


def test_records_round_trip(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    uri = f"file://{tmp_path}/rec"
    shards = records.write_records(docs, uri, path, partitions=3)
    got = records.read_records(shards, uri).orderBy("start").collect()
    whole = Tokenizer.from_file(path)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    start = 0
    for r, (_, text, _) in zip(got, rows, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = got[20]
    path_of = {s["shard"]: s["path"] for s in shards.collect()}
    assert records.fetch(uri, path_of[one["shard"]], one["offset"])[1].tolist() == one["ids"]
    none = records.write_records(empty, f"{uri}-none", path)
    assert none.count() == 0


def test_corrupt_records_are_refused():
    data = bytearray(records.frame(5, np.array([1, 70000], np.uint32)))
    assert records.unframe(bytes(data))[:1] == (5,)
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="corrupt"):
            records.unframe(bytes(bad))


def packed_well(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, with_ids=True, capacity=256).collect()
    used = packed_well(rows, 256)
    total = sum(r["length"] for r in rows)
    assert used <= math.ceil(total / 256) + 2
    whole = Tokenizer.from_file(path)
    want = Counter()
    for i, text, _ in corpus():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        at, cut, piece = 0, len(ids) % 256 or 256, 0
        while at < len(ids):
            want[i, piece, at, tuple(ids[at : at + cut])] += 1
            at, cut, piece = at + cut, 256, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows) == want
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_rank_once(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([rng.randint(1, 64), 64, rng.randint(20, 30)]) for _ in range(rng.randint(1, 3000)))
    segments, sequences = packing.plan(dict(histogram), 64)
    room = defaultdict(list)
    for length, n in histogram.items():
        own = sorted((r, times) for x, r, times, _, _ in segments if x == length)
        assert [r for r, _ in own] == [sum(t for _, t in own[:k]) for k in range(len(own))]
        assert sum(t for _, t in own) == n
    for length, _, times, first, at in segments:
        for s in range(first, first + times):
            room[s].append((at, length))
    assert len(room) == sequences
    assert all(sum(n for _, n in parts) <= 64 and [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] for parts in room.values())
    assert sequences <= math.ceil(sum(k * v for k, v in histogram.items()) / 64) * 1.05 + 2


# --- 3 and 9 ---


def labelled(spark, bad):
    rows, labels = [], []
    for i in range(900):
        kind = i % 6 == 0
        rows.append((i, bad(i) if kind else prose(30 + i % 20, i), "en", "s", 0))
        labels.append((i, 0 if kind else 1, 1 if kind else 0))
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (None, "abc def", "en", "s", 0), (5, prose(35, 5), "en", "s", 0)]
    labels += [(3, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("x", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i if i is not None else "null").encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda i: " ".join(w.upper() + "!!" for w in prose(30, i).split()))
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 904
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"]) for r in rows)
    got = [(r["predicted"], r["doc_id"] % 6 != 0) for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)


def test_scores_without_labels(spark, empty):
    docs, labels = labelled(spark, lambda i: "x")
    none = labels.where("false")
    assert quality.score_quality(docs.limit(5), none).count() == 5
    assert quality.score_quality(empty, labels).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, none)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    words_, ends = ["zorg", "quuxa", "idiot"], ["aba", "bec", "cid", "dof", "eg", "fuh", "gah", "hebb", "ich", "jok"]
    bad = lambda i: [*words_, "blarg" + ends[i // 24 % 10]][i // 6 % 4]
    docs, labels = labelled(spark, lambda i: prose(12, i) + f" you {bad(i)} " + prose(12, -i))
    docs = docs.union(docs.where("doc_id = 6").withColumn("text", F.lit("fine words " * 60_000)))
    model = toxicity.fit(docs, labels)
    assert {"zorg", "quuxa", "blarg*"} <= set(model.entries)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 905
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"]) for r in rows)
    got = [(r["predicted"], r["doc_id"] % 6 == 0) for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.where("doc_id >= 9000").count() == 2
    # negated and reported insults score clearly below plain ones, and words that begin like an entry don't count
    plain, target, negated, reported = model.score(["what an idiot.", "you are an idiot.", "you are not an idiot.", "he said she is an idiot."])
    assert target > plain > max(negated, reported) + 0.3
    assert model.score(["Good morning.", "Please close the door.", "We discuss training tomorrow.", "kill your speed", "idiotic zorgs, blarg"]).max() < 0.1


def plain_sums(text, entries):
    """The grammar's sums word by word, without machines or automaton."""
    sums = [0.0] * 4
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        negated, reported, targeted = 0, False, False
        for m in re.finditer(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause):
            w, head = m.group(), re.match(r"[^\W\d_]+", m.group()).group()
            before = clause[m.start() - 1 : m.start()] if m.start() else ""
            own = [x for e, x in entries.items() if (head == e or e.endswith("*") and head.startswith(e[:-1]) and head != e[:-1])]
            threat = any(re.match(re.escape(t) + r"(?![^\W\d_])", clause[m.start() :]) for t in toxicity.THREATS)
            if (own or threat) and not before.isalpha():
                kind = 3 if reported else 2 if negated else 1 if targeted else 0
                sums[kind] += max([*own, *([toxicity.THREAT] if threat else [])])
            elif w in toxicity.TARGETS:
                targeted, negated = True, max(0, negated - 1)
            elif w in toxicity.NEGATIONS:
                negated = 3
            elif w in toxicity.REPORTS:
                reported, negated = True, max(0, negated - 1)
            else:
                negated = max(0, negated - 1)
    return sums


def test_grammar_matches_brute_force():
    entries = {"moron": 1.0, "idiot": 1.0, "vequ*": 0.5, "los*": 0.25}
    grammar, rng = toxicity.Grammar(entries), random.Random(12)
    parts = ["moron", "idiot", "idiots", "vequ", "vequa", "lost", "los", "you", "she", "not", "isn't", "said", "wrote", "kill you", "kill your", "fine", "day", "a", "oxymoron", "tu", "pas", ".", "!", ";", "\n", ",", "3x", "Moron", "ÉL"]
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert grammar.sums(text) == pytest.approx(plain_sums(text, entries)), text


def test_grammar_tells_negated_and_reported_clauses():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 1.0))
    x = {k: dict(zip(toxicity.KINDS, g.sums(t), strict=True)) for k, t in {"plain": "what a moron.", "targeted": "you moron.", "negated": "you are not a moron.", "reported": "he said she is a moron.", "clean": "a fine day.", "inside": "oxymoronic words", "quoted threat": "he said he would kill you"}.items()}
    for kind in toxicity.KINDS:
        assert x[kind][kind] > 0
        assert sum(v > 0 for v in x[kind].values()) == 1
    assert not any(x["clean"].values()) and not any(x["inside"].values())
    assert x["quoted threat"]["reported"] == toxicity.THREAT


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    centre, value = isotonic(x, (rng.uniform(size=500) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(centre) > 0).all()
    assert (np.diff(value) >= -0.2).all()
    assert value[0] < 0.3 < 0.7 < value[-1]


# --- 4 ---


def test_katz_matches_brute_force(docs, empty):
    rows = corpus()
    tokens = [[*words(t), None] for _, t, _ in rows]
    out = [zlib.crc32(str(i if i is not None else "null").encode()) % 10 == 0 for i, _, _ in rows]
    one, two, total = Counter(), Counter(), Counter()
    for w, h in zip(tokens, out, strict=True):
        if not h:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    uni, d = katz.Unigrams.of(Counter(one.values()), n, v), katz.discounts(Counter(two.values()), 2)
    p = lambda w: float(uni.probability(np.array([one[w]]))[0])
    stored = defaultdict(dict)
    for (a, b), c in two.items():
        total[a] += c
        if c >= 2:
            stored[a][b] = c
    model = {}
    for a, f in stored.items():
        q = {b: (1 if c > katz.SMALL else d[c]) * c / total[a] for b, c in f.items()}
        low = 1 / (total[a] + 1)
        scale = (1 - low) / sum(q.values()) if 1 - sum(q.values()) < low else 1
        q = {b: x * scale for b, x in q.items()}
        model[a] = q, (1 - sum(q.values())) / (1 - sum(p(b) for b in q))
        whole = sum(q.get(b, model[a][1] * p(b)) for b in one) + model[a][1] * uni.unseen
        assert whole == pytest.approx(1)
    assert sum(p(w) for w in one) + uni.unseen == pytest.approx(1)
    want = []
    for (i, _, _), w, h in zip(rows, tokens, out, strict=True):
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(model[a][0].get(b, model[a][1] * p(b)) if a in model else p(b)) for a, b in zip([None, *w[:-1]], w, strict=True))
        want.append((i, h, len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score_texts(docs, min_count=2).collect()]
    assert Counter(got) == Counter(want)
    assert katz.score_texts(empty).count() == 0


def test_katz_query_keeps_bigrams_seen_once(spark, docs, tmp_path):
    from maskloom.llm.queries import QUERIES

    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus()
    tokens = [[*words(t), None] for _, t, _ in rows]
    out = [zlib.crc32(str(i if i is not None else "null").encode()) % 10 == 0 for i, _, _ in rows]
    trained = [w for w, h in zip(tokens, out, strict=True) if not h]
    one, two = Counter(x for w in trained for x in w), Counter(x for w in trained for x in zip([None, *w[:-1]], w, strict=True))
    uni, d = katz.Unigrams.of(Counter(one.values()), sum(one.values()), len(one)), katz.discounts(Counter(two.values()))
    p = lambda w: float(uni.probability(np.array([one[w]]))[0])
    followers = defaultdict(dict)
    for (a, b), c in two.items():
        followers[a][b] = c
    assert 1 in two.values()
    assert d[1] > 0
    model = {}
    for a, f in followers.items():
        total = sum(f.values())
        q = {b: (1 if c > katz.SMALL else d[c]) * c / total for b, c in f.items()}
        low, used = 1 / (total + 1), sum(q.values())
        q = {b: x * ((1 - low) / used if 1 - used < low else 1) for b, x in q.items()}
        model[a] = q, (1 - sum(q.values())) / max(1 - sum(p(b) for b in q), 1e-12)
    score = lambda w: sum(math.log10(model[a][0].get(b, model[a][1] * p(b)) if a in model else p(b)) for a, b in zip([None, *w[:-1]], w, strict=True))
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in QUERIES["op4_katz_backoff"](spark, str(tmp_path)).collect())
    assert got == Counter((i, round(score(w), 6)) for (i, _, _), w in zip(rows, tokens, strict=True))


# --- 5 ---


def brute_components(rows, size, percent):
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least_id = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        if i is not None and (r not in least_id or i < least_id[r]):
            least_id[r] = i
    return Counter((i, len(sets[k]), least_id.get(find(k))) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 4096), (5, 80, 40)])
def test_jaccard_matches_brute_force(docs, empty, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)  # 40: groups go in blocks
    got = jaccard.jaccard_components(docs, size, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(corpus(), size, percent)
    assert jaccard.jaccard_components(empty).count() == 0


def test_trie_finds_all_links():
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(40), rng.randint(5, 30))) for _ in range(80)]
    sets += [sorted(set(s) - {s[0]}) for s in sets[:40]]
    trie = jaccard.Trie()
    for k, s in enumerate(sets):
        trie.add(tuple(s), k, len(s))
    for s in sets:
        want = {k for k, o in enumerate(sets) if 100 * len({*s} & {*o}) >= 70 * len({*s} | {*o})}
        assert set(trie.search(frozenset(s), len(s), 70)) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(500, 500), (7, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6 ---


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_match_is_the_least_over_runs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        got = contamination.edit_match(item, text)
        runs = [(edit(item, text[a:b]), a, b) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
        assert got[0] == min(r[0] for r in runs)
        assert edit(item, text[got[1] : got[1] + got[2]]) == got[0]


def test_contamination_finds_edited_items(spark, docs, empty):
    rng = random.Random(9)
    items = [(k, prose(20 + k, f"item{k}")) for k in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, "an item without an id")]
    planted, clean = [], []
    for k in range(20):
        w = items[k][1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "zzzz"
        planted.append((1000 + k, prose(15, f"x{k}") + " " + " ".join(w).upper() + " " + prose(15, f"y{k}"), "en", "s", 0))
        clean.append((2000 + k, prose(80, f"c{k}"), "en", "s", 0))
    both = spark.createDataFrame([*planted, *clean, (3000, None, "en", "s", 0), (3001, "", "en", "s", 0)], DOCS).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in contamination.find_contamination(both, bench).collect()}
    assert set(got) == {(1000 + k, k) for k in range(20)}
    assert all(e <= k % 4 for (_, k), e in got.items())
    kept = contamination.drop_contaminated(both, bench)
    assert kept.columns == both.columns
    assert {r["doc_id"] for r in kept.collect()} == {2000 + k for k in range(20)} | {3000, 3001}
    assert contamination.find_contamination(empty, bench).count() == 0
    assert contamination.find_contamination(both, bench.where("false")).count() == 0


# --- 7 ---


def test_substrings_match_brute_force(docs, empty):
    rows = corpus()
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t, _ in rows:
        w = words(t, False)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 2**63), key(i))
    want = Counter()
    for i, t, _ in rows:
        w = words(t, False)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    got = substrings.dedup_substrings(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got) == want
    assert all(sum(s["words"] for s in r["removed"]) == r["n_removed"] for r in got)
    assert substrings.dedup_substrings(empty).count() == 0


# --- 10 ---


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        centre = rng.normal(size=16)
        for _ in range(1 + k % 4):
            rows.append([centre + rng.normal(size=16) * 0.05, k % 3])
    hot = rng.normal(size=16)
    rows += [[hot + rng.normal(size=16) * 0.02, 1] for _ in range(150)]  # more near neighbours than a window holds
    rows += [[hot, 1]] * 40 + [[hot * 3, 2], [np.zeros(16), 1], [rng.normal(size=16), None]]
    data = [(k, [float(x) for x in v], label) for k, (v, label) in enumerate(rows)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None] * 8, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1e308] * 16, 0), (n + 5, [1e308] * 16, 0), (n + 6, [1.0] * 8, 0), (None, [float(x) for x in hot], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x")).withColumn("unit", F.lit("x"))
    good = [(i, np.array(v) / np.abs(v).max(), label) for i, v, label in data if i is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0 and label is not None]
    links, parent = Counter(), {i: i for i, *_ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v, lv) in enumerate(good):
        for j, w, lw in good[:a]:
            if lv == lw and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = sorted((i, links[i], find(i), find(i) == i) for i, *_ in data if i is not None)
    got = neighbours.near_duplicates(df).collect()
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None) == want
    assert [r["n_links"] for r in got if r["vec_id"] is None] == [0]
    assert neighbours.near_duplicates(df.where("false")).count() == 0


def test_neighbours_of_small_partitions(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=64)
    rows = [hot + rng.normal(size=64) * 0.05 for _ in range(300)] + [rng.normal(size=64) for _ in range(100)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.98).sum(1) - 1
    assert want[:300].min() == 299
    df = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict(enumerate(want.tolist()))


def test_neighbours_of_a_tight_label(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=64)
    middle *= 3 / np.linalg.norm(middle)  # cosines of about 0.9 to one another
    spread = lambda n, by: rng.normal(size=(n, 64)) / 8 * by
    rows = middle + spread(1200, 1.0)
    rows = np.concatenate([rows, rows[:200] + spread(200, 0.58)])
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.98).sum(1) - 1
    assert want.sum() > 300
    df = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(df, window=8).collect()} == dict(enumerate(want.tolist()))


# --- pipeline ---


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    toxic = [(700 + k, prose(20, f"t{k}") + " you stupid moron " + prose(5, f"u{k}")) for k in range(3)]
    item = prose(30, "leak")
    leaks = [(800, prose(30, "l") + " " + item + " " + prose(30, "m"))]
    more = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in toxic + leaks], DOCS)
    sf = str(tmp_path)
    source = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
    source.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, common.materialise(stage(spark, at, sf), name)
        assert at.columns == source.columns
        ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
        gone = ids(before) - ids(at)
        if name == "toxicity":
            assert set(gone) == {700, 701, 702}
        elif name == "line_dedup":
            assert not gone
        elif name == "decontamination":
            assert set(gone) == {800}
        else:
            texts = [(r["doc_id"], r["text"], None) for r in before.collect()]
            want = {i for i, _, c in brute_components(texts, 5, 80) if i == c} | {i for i, _, c in brute_components(texts, 5, 80) if c is None}
            assert set(ids(at)) == want
    rows = corpus_pipeline.run(spark, sf).collect()
    packed_well(rows, 1024)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in at.collect()}
