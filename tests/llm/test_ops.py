"""The operators against brute force, exact round trips and their defined edge cases."""

import math
import random
import zlib
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import components, embedding_dedup, hamming_search, license_scan, line_dedup, mixing, packing, repair, simhash_docs, token_counts, token_files, toxicity
from millrace.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from millrace.llm.word_ids import WordIds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "  lead", "tail  ", "a   b", "a\n\n b", "x\t\ty", "<|endoftext|>", "hi<|endoftext|> there", "<|startoftext|>A B", "İstanbul ΑΣ", "\x1c a \x1d b", "don't 'S it''s 'll!'s", "é à", "１２３ ½", "日本語 テスト", "a b c", "ﬁ ǅ ŉ", "a" * 3000, "😀😀 ok", "\r\n\r\nq", "a\x85 b", "One. Two! Three? (four.)", "the cat sat on the mat " * 400]


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def odd_rows(spark):
    """Nulls, repeated rows and ids, empty texts, and a column whose name clashes with a helper's."""
    rows = [(None, "some words in a row here", None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "same text for two rows of it", "en", "s", 5), (3, "same text for two rows of it", "en", "s", 5), (3, "another text under the same id", "en", "t", 5)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x"))


def test_token_counts_are_the_librarys(spark):
    own = Tokenizer.from_file(BYTE_VOCABULARY)
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, [*ODD, None]), BYTE_VOCABULARY).collect()}
    for i, t in enumerate(ODD):
        assert got[i].n_tokens == len(own.encode(t, add_special_tokens=False).ids), t[:30]
        assert got[i].n_bytes == len(t.encode()) and got[i].over_limit == (got[i].n_tokens > 512)
    assert (got[len(ODD)].n_tokens, got[len(ODD)].n_bytes) == (0, 0)


def test_word_ids_are_the_librarys_even_when_the_cache_turns_over():
    own, fast = Tokenizer.from_file(WORD_VOCABULARY), WordIds(WORD_VOCABULARY, most=30)
    for _ in range(2):
        for lo in range(0, len(ODD), 5):
            part = ODD[lo : lo + 5]
            ids, at = fast.encode(pa.array(part, pa.large_string()))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [own.encode(t, add_special_tokens=False).ids for t in part]


def test_grammar_round_trip_and_random_access():
    rng = random.Random(1)
    lists = [[rng.choice([5, 6, 7, 8]) for _ in range(rng.choice([1, 2, 50, 400]))] + [2] for _ in range(60)] + [[9] * 500 + [2]]
    ids, first = np.concatenate([np.array(x, np.int32) for x in lists]), np.cumsum([0, *map(len, lists)])
    g = repair.from_bytes(repair.to_bytes(repair.compress(ids, first, np.arange(len(lists)), np.ones(len(lists), bool), 70_000)))
    assert (repair.expand(g) == ids).all() and len(g.symbols) < len(ids) / 2 and len(g.rules)
    for k, x in enumerate(lists):
        lo = rng.randrange(len(x))
        assert repair.ids_at(g, k) == x and repair.ids_at(g, k, lo, 3) == x[lo : lo + 3]


def test_token_files_hold_the_stream_in_order(spark):
    own, texts = Tokenizer.from_file(WORD_VOCABULARY), [*ODD, None]
    start = 0
    for r in sorted(token_files.token_files(docs(spark, texts), WORD_VOCABULARY).collect()):
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(odd_rows(spark), WORD_VOCABULARY).count() == 6
    assert token_files.token_files(docs(spark, []), WORD_VOCABULARY).count() == 0


def test_packing_covers_every_id_once(spark):
    own, texts = Tokenizer.from_file(WORD_VOCABULARY), [*ODD, None] * 3
    rows = packing.pack(docs(spark, texts), WORD_VOCABULARY).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids, at = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WIDTH
    assert packing.pack(odd_rows(spark), WORD_VOCABULARY).where("start + length = doc_tokens").count() == 6
    assert packing.pack(docs(spark, []), WORD_VOCABULARY).count() == 0


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(50):
        places = sorted({0, *rng.sample(range(1, 60), 12), 60})
        gaps = [b - a for a, b in zip(places, places[1:], strict=False)]
        width = max(16, max(gaps))
        penalties = [rng.choice([0, 6, 48]) for _ in places]
        cuts, cost = packing.best_cuts(places, penalties, width)
        free = {width >> j for j in (1, 2, 3)} if width & (width - 1) == 0 else set()
        best = [0] + [math.inf] * (len(places) - 1)
        for k in range(1, len(places)):
            for i in range(k):
                n = places[k] - places[i]
                if n <= width:
                    best[k] = min(best[k], best[i] + (0 if n in free else width - n) + packing.OVERHEAD + penalties[k])
        assert cost == best[-1] and cuts[0] == 0 and cuts[-1] == len(places) - 1


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    n = min(3, len(w))
    h = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), seed=42).intdigest() for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_fingerprints_and_empty_texts(spark):
    texts = ["One two THREE four", "É two", "", None, "one", "a b\tc\nd a b c d"]
    got = {r.doc_id: r for r in simhash_docs.simhash_components(docs(spark, texts)).collect()}
    assert {i: got[i].fingerprint for i in got} == {i: f"{brute_fingerprint(t or ''):016x}" for i, t in enumerate(texts)}
    assert got[3].component_id == 2
    assert simhash_docs.simhash_components(docs(spark, [])).count() == 0
    kept = simhash_docs.one_of_each(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns and kept.where("doc_id = 3").count() == 2


def test_the_pipeline_keeps_unlinked_texts_of_one_doc_id(spark):
    import corpus_pipeline

    rows = [(1, "one text of its own kind"), (2, "one text of its own kind"), (2, "quite another text under that id"), (2, "quite another text under that id"), (2, "third words nobody else has here")]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({rows[0], rows[2], rows[4]})

def test_codes_within_three_bits_are_found_and_no_others(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    codes = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {r.node: r.component for r in simhash_docs.code_components(spark.createDataFrame([(signed(c),) for c in codes], "code long")).collect()}
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)), key=signed)
                root[y] = x
    assert {signed(c): found.get(signed(c), signed(c)) for c in codes} == {signed(c): signed(find(c)) for c in codes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(60)) and got[301] == 300


def test_fuzzy_lines_keep_the_first_of_each_group(spark):
    long = " ".join(f"lengthy{i} token{i}" for i in range(40))
    near = long + " it"  # one short word more: the same fingerprint
    far = " ".join(f"different{i} content{i}" for i in range(40))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, [f"{long}\nshort one\n", f"{far}\n{near.upper()}!", f"short one\n{long}\n{long}"])).collect()}
    assert out[0].text == f"{long}\nshort one\n" and out[1].text == far and out[2].text == "short one"
    assert [out[i].n_dropped for i in range(3)] == [0, 1, 2] and out[1].n_chars == len(far)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_grammar_leaves_no_frequent_pair():
    rng = random.Random(3)
    passage = [rng.randrange(5, 60_000) for _ in range(64)] + [2]
    lists = [passage] * 3000 + [[9] * 500 + [2]]
    ids, first = np.array(sum(lists, []), np.int32), np.cumsum([0, *map(len, lists)])
    g = repair.compress(ids, first, np.arange(len(lists)), np.ones(len(lists), bool), 70_000)
    assert (repair.expand(g) == ids).all() and repair.ids_at(g, 7) == passage and repair.ids_at(g, 3000, 3, 4) == [9] * 4
    assert len(g.symbols) < 3020


def test_no_pair_repeats_in_a_finished_grammar():
    rng = random.Random(8)
    for _ in range(60):
        lists = [[rng.randrange(5, rng.choice([7, 9, 40])) for _ in range(rng.choice([1, 2, 3, 30, 200]))] for _ in range(rng.choice([1, 20]))]
        ids, first = np.array(sum(lists, []), np.int32), np.cumsum([0, *map(len, lists)])
        g = repair.from_bytes(repair.to_bytes(repair.compress(ids, first, np.arange(len(lists)), np.ones(len(lists), bool), 66_000)))
        assert (repair.expand(g) == ids).all() and [repair.ids_at(g, k) for k in range(len(lists))] == lists
        seen = set()
        for k in range(len(lists)):
            symbols, at = g.symbols[g.first_symbol[k] : g.first_symbol[k + 1]].tolist(), 0
            while at + 1 < len(symbols):
                pair = tuple(symbols[at : at + 2])
                assert pair not in seen
                seen.add(pair)
                at += 2 if symbols[at] == symbols[at + 1] and symbols[at : at + 3] == symbols[at : at + 1] * 3 else 1


def test_line_links_are_those_of_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 5, 8])))
    common = [word() for _ in range(30)]
    lines = []
    for n in (4, 5, 6, 8, 9, 12, 14, 20, 40, 90) * 4:
        line = [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
        lines.append(line)
        for share in (0.1, 0.2, 0.2, 0.25):  # the last one goes beyond what may link
            other = list(line)
            for _ in range(max(1, math.floor(n * share + 1e-9))):
                k, how = rng.randrange(len(other)), rng.randrange(3)
                other[k : k + (how != 1)] = [] if how == 2 else [word()]
            lines.append(other)
    lines += [[w, w, w] + ["x"] * k for w in ("aa", "bb") for k in range(3, 7)]  # keys that repeat in a line
    lines = [x for x in lines if len(x) >= 4]
    rng.shuffle(lines)
    root, links = list(range(len(lines))), set()
    for j, b in enumerate(lines):
        for i in range(j):
            if edits(lines[i], b) <= math.floor(max(len(lines[i]), len(b)) * 0.2 + 1e-9):
                links.add((i, j))
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    table = docs(spark, [" ".join(x) for x in lines])
    out = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table, runs=None).collect()}
    assert 60 < sum(out.values()) and out == {i: int(root[i] != i) for i in range(len(lines))}
    some = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table).collect()}
    assert all(some[i] <= out[i] for i in out) and sum(some.values()) >= 0.9 * sum(out.values())
    met = {r.doc_id: set(r["keys"]) for r in line_dedup.keyed_lines(table).collect()}
    assert sum(bool(met[i] & met[j]) for i, j in links) >= 0.9 * len(links)
    every = {r.doc_id: set(r["keys"]) for r in line_dedup.keyed_lines(table, None).collect()}
    assert all(every[i] & every[j] for i, j in links)


def test_the_query_and_the_pipeline_drop_exact_repeats_of_any_length(spark, tmp_path):
    import corpus_pipeline
    from millrace.llm.queries import QUERIES

    han = "今天天气很好我们一起去公园散步然后回家吃饭"
    texts = [f"Short one\n{han}\n--\n\nshort two", f"short ONE!\n{han}\n--\n\nshort too", f"{han[:7]}真{han[8:]}\nother"]
    want = [texts[0], "--\n\nshort too", "other"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert [out[i].text for i in range(3)] == want and [out[i].n_dropped for i in range(3)] == [0, 2, 1]
    stage = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs(spark, texts), str(tmp_path)).collect()}
    assert [stage[i] for i in range(3)] == want


def test_line_dedup_edge_rows(spark):
    rows = odd_rows(spark)
    out = line_dedup.dedup_lines(rows)
    assert out.columns[: len(rows.columns)] == rows.columns and out.count() == 6
    assert out.where("doc_id = 1").first().text is None and out.where("doc_id is null").first().text == "some words in a row here"
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_poisson_counts_follow_the_distribution(spark):
    for rate in (1e-3, 0.3, 2.5, 31.5, 900.0, 1e5, 1e7):
        row = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("p")).first().p
        p, k = np.array(row.p), np.arange(row.lo, row.lo + len(row.p))
        assert abs(math.fsum(p) - 1) < 1e-12, rate
        with localcontext() as exact:  # logarithms of 40 digits
            exact.prec = 40
            top = int(rate)
            mode = Decimal(top) * Decimal(rate).ln() - Decimal(rate) - sum((Decimal(j).ln() for j in range(1, top + 1)), Decimal(0)) if top < 2000 else None
        if mode is not None:
            assert math.isclose(p[top - row.lo], float(mode.exp()), rel_tol=1e-12)
        assert np.allclose(p[1:][p[1:] > 1e-25], (p[:-1] * rate / k[1:])[p[1:] > 1e-25], rtol=1e-10, atol=0)
    draws = [0.0, 0.2, 0.5, 0.9999]
    got = spark.createDataFrame([(x,) for x in draws], "x double").select(mixing.inverted(mixing.poisson_table(F.lit(2.5)), F.col("x")).alias("n")).collect()
    cdf = np.cumsum([math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(40)])
    assert [r.n for r in got] == [int((cdf <= x).sum()) for x in draws]
    many = docs(spark, ["x" * 10] * 900, "big").union(docs(spark, ["x" * 10] * 100, "small").withColumn("doc_id", F.col("doc_id") + 10_000))
    out = mixing.mix(many, {"big": 1.0, "small": 1.0}).groupBy("source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()
    for r in out:
        assert abs(r.n - 500) < 100 and math.isclose(r.rate, 500 / (900 if r.source == "big" else 100))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert set(mixing.mix(odd_rows(spark)).columns) >= set(odd_rows(spark).columns)


def test_grammar_of_clauses():
    g = toxicity.Grammar({"idiot$": 4.0, "zurgh": 4.0, "kill$": 4.0})
    plain, aimed, negated, said = (sum(s for *_, s in g.clauses(t)) for t in ("an idiot here", "you idiot", "not an idiot here", "he reported an idiot"))
    assert aimed > plain > negated > 0 and said < aimed
    assert g.clauses("idiots abound") == [] and len(g.clauses("Zurghli one. clean. zurghta!")) == 2 and g.clauses("") == []


def test_one_more_insult_never_lowers_a_clause():
    rng, g = random.Random(4), toxicity.Grammar({"idiot$": 4.0, "moron$": 3.0, "kill$": 5.0})
    words = ["idiot", "moron", "kill", "you", "i", "not", "said", "plain", "words"]
    for _ in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(9))]
        before = sum(s for *_, s in g.clauses(" ".join(w)))
        for k in range(len(w) + 1):
            assert sum(s for *_, s in g.clauses(" ".join([*w[:k], "idiot", *w[k:]]))) >= before - 1e-9


def test_the_composed_machine_is_the_chain():
    rng = random.Random(6)
    chain, whole = (toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.targeted()), toxicity.machine()
    for _ in range(300):
        labels = [rng.choice(toxicity.CLASSES) for _ in range(rng.randrange(12))]
        weights, now = np.zeros(len(labels)), labels
        end = 0.0
        for t in chain:
            state, out = 0, []
            for k, x in enumerate(now):
                state, y, w = t.step(state, x)
                out.append(y)
                weights[k] += w
            now, end = out, end + t.final.get(state, 0.0)
        state, got = 0, []
        for x in labels:
            state, y, w = whole.step(state, x)
            got.append((y, w))
        assert [y for y, _ in got] == now and np.allclose([w for _, w in got], weights) and math.isclose(whole.final.get(state, 0.0), end, abs_tol=1e-12)


def test_toxicity_of_empty_tables_and_very_long_texts(spark):
    known = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs(spark, []), known).count() == 0
    long = toxicity.toxicity(docs(spark, ["idiot! " * 100_000, "plain " * 100_000, ""]).withColumn("score", F.lit("x")), known.limit(0)).collect()
    assert {r.doc_id: (r.n_clauses, r.predicted) for r in long} == {0: (100_000, 1), 1: (0, 0), 2: (0, 0)}


def test_toxicity_learns_stems_and_never_reads_held_out_labels(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(50)) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "gruzzel" + rng.choice("abcdef"))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(docs(spark, texts), known).collect()
    assert all(r.predicted == labels[r.doc_id][1] for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(docs(spark, texts), flipped).collect()) == sorted(out)
    odd = toxicity.toxicity(odd_rows(spark), known.limit(0))
    assert odd.count() == 6 and odd.where("score > 0.5").count() == 0


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    x = np.concatenate([base, base[:20], base[:30] + rng.standard_normal((30, 64)) * 0.05, base[:1] + rng.standard_normal((80, 64)) * 0.04]).astype(np.float32)
    labels = [int(i % 2) if i < 110 else 0 for i in range(len(x))]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, rows[0][1], None), (904, [None] * 64, 0)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x))) and found >= 0.97 * links.sum()
    for i in range(900, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_large_buckets_are_split_without_losing_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((1, 64)) + rng.standard_normal((300, 64)) * 0.001).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    out = embedding_dedup.embedding_components(spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()
    assert {r.n_links for r in out} == {299} and {r.component_id for r in out} == {0}


def test_rotated_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(8)
    for d in (64, 100):
        a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 400, d)))
        b[:100] = a[:100] + 0.02 * b[:100]
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        guess, error = embedding_dedup.Codes.of(a).estimates(embedding_dedup.Codes.of(b))
        off = guess - a @ b.T
        assert abs(off.mean()) < 0.005 and abs(np.diag(off)[:100].mean()) < 0.05 and (np.abs(off) <= error).mean() > 0.999


def test_open_pairs_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(9)
    x = rng.standard_normal((1, 64)) + rng.standard_normal((embedding_dedup.BLOCK, 64)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    codes, every, n = embedding_dedup.Codes.of(x), np.arange(len(x)), 0
    for i, j in codes.open_pairs(every, every):
        n += embedding_dedup.exact(x, i, j).sum()
    assert n == len(x) * (len(x) - 1) // 2 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_embedding_edge_rows(spark):
    schema = "vec_id long, embedding array<double>, label string, node string, copies int"
    big = [1e200, -1e200, 3e199]
    rows = [(None, [1.0, 2.0, 3.0], "a", "x", 1), (5, [1.0, 2.0, 3.0], "a", "x", 1), (5, [1.0, 2.0, 3.001], "a", "x", 1), (7, [1.0, 2.0], "a", "x", 1), (8, [], "a", "x", 1)]
    rows += [(9, big, "b", "x", 1), (10, [v * 1e-3 for v in big], "b", "x", 1), (11, [1e-200, -1e-200, 3e-201], "b", "x", 1), (12, [1.0, 2.0, 3.0], None, "x", 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in embedding_dedup.embedding_components(df).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (8, 0, 8), (9, 2, 9), (10, 2, 9), (11, 2, 9), (12, 0, 12)]
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_hamming_search_is_exact(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = [c ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else c for c in base * 12]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(c)) for i, c in enumerate(codes)], "id long, code long")
    out = hamming_search.top_k(df, df.where("id % 20 = 0"), 5).collect()
    got = {}
    for r in sorted(out):
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    assert got == {q: sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:5] for q in range(0, len(codes), 20)}
    bad = spark.createDataFrame([(0, None), (1, [None] * 64), (2, [1.0] * 3)], "vec_id long, embedding array<float>")
    assert hamming_search.sign_codes(bad).count() == 0


def test_patience_alignment_and_scan(spark):
    assert license_scan.align(list("abcde"), list("xabzcde")) == [(0, 1), (1, 2), (2, 4), (3, 5), (4, 6)]
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    texts = [f"Some text. {mit} More text. released UNDER the mit license again", f"words words {gpl}", "this license of mine is mine", "", None, gpl.replace("General", "Generous"), gpl.replace("work is", "book was")]
    texts += ["Released under the BSD License.", "Licensed under CC BY-SA 4.0.", gpl.replace("version 3", "version 2"), license_scan._BSD_TWO + license_scan._BSD_END, "word " * 50_000 + mit]
    got = sorted((r.doc_id, r.license, r.start_word, round(r.coverage, 2)) for r in license_scan.license_scan(docs(spark, texts)).collect())
    assert got == [(0, "MIT", 5, 1.0), (0, "MIT", 12, 1.0), (1, "GPL-3.0", 8, 1.0), (6, "GPL-3.0", 6, 1.0), (8, "CC-BY-SA-4.0", 2, 1.0), (9, "GPL-2.0", 6, 1.0), (10, "BSD-2-Clause", 0, 1.0), (11, "MIT", 50_003, 1.0)]
    odd = odd_rows(spark).withColumn("license", F.lit("x")).withColumn("text", F.when(F.col("doc_id") == 3, F.lit(mit)).otherwise(F.col("text")))
    assert [(r.doc_id, r.license) for r in license_scan.license_scan(odd).collect()] == [(3, "MIT")] * 3
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_notices_in_other_words_and_what_isnt_one():
    own = [license_scan.Template(*t, license_scan.COVERAGE) for t in license_scan.TEMPLATES]
    of = lambda text: [x[1].license for x in license_scan.scan([text], own)]
    assert of("Licensed under CC BY 4.0 and CC BY-SA 4.0") == ["CC-BY-4.0", "CC-BY-SA-4.0"]
    assert of("Licensed under the GNU General Public License version 2 or later.") == ["GPL-2.0"] == of("GNU General Public License, version 2")
    assert of("MIT License") == ["MIT"] == of("SPDX-License-Identifier: MIT") and of("SPDX-License-Identifier: GPL-3.0-or-later") == ["GPL-3.0"]
    assert of("Creative Commons Attribution 4.0") == ["CC-BY-4.0"] and of("Licensed under CC BY 3.0") == ["CC-BY-3.0"]
    assert of("This is not licensed under the MIT License.") == [] == of("never released under the terms of the MIT License") and of("not free, but licensed under the MIT License") == ["MIT"]
    assert of("It has the GNU General Public License and the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert of("a license was under the work of version 2 0") == []


def test_license_scan_against_all_windows():
    rng = random.Random(21)
    own = [license_scan.Template(*t, license_scan.COVERAGE) for t in license_scan.TEMPLATES if len(license_scan.words(t[2])) < 60]
    noise = [f"n{i}" for i in range(40)] + ["license", "under", "the", "version", "work", "4", "0"]
    texts = []
    for k in range(150):
        t = own[k % len(own)]
        body = [w if rng.random() > rng.choice([0, 0.05, 0.1]) else rng.choice(noise) for w in t.words]
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body)), rng.choice(noise))
        texts.append([rng.choice(noise) for _ in range(rng.randrange(12))] + body + [rng.choice(noise) for _ in range(12)])
    found = {}
    for k, t, lo, hi, matched in license_scan.scan([" ".join(x) for x in texts], own):
        found.setdefault(k, []).append((lo, hi, matched))
        assert matched >= license_scan.COVERAGE * len(t.words) - 1e-9
    stands = lambda part, x: any(x[i : i + len(part)] == part for i in range(len(x) - len(part) + 1))
    for k, x in enumerate(texts):
        most = 0
        for t in own:
            if all(stands(t.words[a:b], x) for a, b in t.phrases):
                n = max(lcs(t.words, x[i : i + len(t.words) + t.slack]) for i in range(max(1, len(x) - len(t.words) // 2)))
                most = max(most, n if n >= license_scan.COVERAGE * len(t.words) - 1e-9 else 0)
        # where all windows hold a notice the scan reports one, and the best of those it may choose from
        assert (most > 0) == (k in found) and max((m for *_, m in found.get(k, [(0, 0, 0)])), default=0) >= most - 1, " ".join(x)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = max(last + 1 if x == y else 0, row[j], row[j + 1]), row[j + 1]
    return row[-1]


def test_alignment_is_ascending_and_near_the_longest_subsequence():
    rng = random.Random(9)
    for _ in range(100):
        a = [f"w{i}" for i in range(25)]
        b = [w for w in a if rng.random() > 0.15]
        for _ in range(4):
            b.insert(rng.randrange(len(b)), f"x{rng.random()}")
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) and len(pairs) == lcs(a, b)


#: Names of columns and aliases that the operators use inside.
HELPERS = """rate poisson mix_source n_copies copy shuffle_key draw row gone left lines n_lines n_dropped pos raw node n keys first words
part parts id code own own_text component kept key score predicted held_out n_clauses license template label same copies bucket blocks table
other task size start length offset grammar shard before rank query block ask distance toxic weight word stem""".split()


def test_columns_of_any_name_pass_through(spark, tmp_path):
    import corpus_pipeline

    plain = docs(spark, ["one plain text of several words", "one plain text of several words", "another text\nof two lines and more words", None])
    clashing = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in HELPERS))
    known = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    # operators that give rows of their own: the same as without those columns
    for run in (
        lambda d: toxicity.toxicity(d, known), lambda d: token_files.token_files(d, WORD_VOCABULARY), lambda d: token_counts.token_counts(d, BYTE_VOCABULARY),
        lambda d: packing.pack(d, WORD_VOCABULARY), license_scan.license_scan, simhash_docs.simhash_components,
    ):
        assert sorted(run(clashing).collect()) == sorted(run(plain).collect())
    # operators that add columns: all of the input's stay, the added ones have free names
    for run, added in ((mixing.mix, ["rate", "n_copies", "copy", "shuffle_key"]), (line_dedup.dedup_lines, ["n_lines", "n_dropped"])):
        out, bare = run(clashing), run(plain)
        assert out.columns == [*clashing.columns, *(f"{c}_" for c in added)]
        assert out.where(" or ".join(f"{c} != 'own {c}'" for c in HELPERS)).count() == 0
        assert sorted(map(str, out.select(*plain.columns, *(F.col(f"{c}_").alias(c) for c in added)).collect())) == sorted(map(str, bare.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns and sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, stage(spark, plain, str(tmp_path)).collect())), name


def test_the_whole_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    long = "a long text of many words " * 20_000
    toxic = "you idiot! you moron, you worthless scum. idiot! idiot! you idiot"
    rows = [(None, "a row without an id", "en", "s", 3), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, long, "en", "s", 9), (4, long, "en", "s", 9), (4, long, "en", "s", 9), (5, toxic, "en", "s", 9), (6, "clean words that nobody else has", "en", "t", 9)]
    for name, d in (("odd", spark.createDataFrame(rows, SCHEMA)), ("none", spark.createDataFrame([], SCHEMA))):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    own = Tokenizer.from_file(WORD_VOCABULARY)
    whole = {}
    for r in out:
        whole.setdefault((r.doc_id, r.doc_tokens), 0)
        whole[r.doc_id, r.doc_tokens] += r.length
    assert all(n % tokens == 0 for (_, tokens), n in whole.items())  # copies of whole documents
    kept = {k for k, _ in whole}
    assert 5 not in kept and 4 not in kept and kept <= {None, 1, 2, 3, 6}
    size = lambda t: len(own.encode(t, add_special_tokens=False).ids) + 1
    assert {(k, n) for k, n in whole if k in (3, 6)} <= {(3, size(long)), (6, size(rows[-1][1]))}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_empty_tables_and_repeated_rows(spark):
    none = docs(spark, [])
    assert token_counts.token_counts(none, BYTE_VOCABULARY).count() == 0
    odd = odd_rows(spark)
    assert token_counts.token_counts(odd, BYTE_VOCABULARY).where("doc_id = 3").count() == 3
    codes = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (None, 7)], "id long, code long").withColumn("rank", F.lit("x"))
    vectors = spark.createDataFrame([(1, [1.0] * 64, "x"), (1, [1.0] * 64, "x"), (None, [-1.0] * 64, "x"), (2, [0.0] * 64, "x")], "vec_id long, embedding array<double>, rank string")
    assert hamming_search.sign_codes(vectors).count() == 3
    found = hamming_search.top_k(codes.where("id is not null").select("id", "code"), codes.where("id is not null").select("id", "code"), 5)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 0), (1, 2, 2, 0), (2, 1, 1, 0), (2, 2, 2, 0)]
    empty = codes.where("id > 9").select("id", "code")
    assert hamming_search.top_k(empty, empty).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "SimHash near-dedup", "mixing"])
def test_stages_return_the_columns_of_documents(spark, tmp_path, name):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs(spark, ["a text of some words here to keep", "another text of other words there"])
    out = dict(corpus_pipeline.STAGES)[name](spark, d, str(tmp_path))
    assert out.columns == d.columns and out.dtypes == d.dtypes
