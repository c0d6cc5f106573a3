import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import components, exact_dedup, langid, licenses, line_dedup, oracles, order_minhash, quality, toxicity
from tideline.session import Scratch

WORDS = [f"w{k}" for k in range(3000)]


def text_of(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def mutated(draw, text, rate):
    return " ".join(draw.choice(WORDS) if draw.random() < rate else w for w in text.split())


def sql_rows(docs, sql):
    frame = docs.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    return con.sql(sql).df()


def same(got, want):
    want = want[sorted(want.columns)].astype(object)
    got = got[sorted(want.columns)].astype(object)
    plain = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f.where(f.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def unique_ids(docs):
    return docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live, draw = exact_dedup.CuckooIndex(4), {}, random.Random(1)
    for step in range(20_000):
        digest = hashlib.sha256(b"%d" % draw.randrange(3000)).digest()
        if digest in live:
            assert index.get(digest) == live[digest]
            if draw.random() < 0.4:
                assert index.delete(digest) == live.pop(digest)
        else:
            assert index.get(digest) is None and index.delete(digest) is None
            live[digest] = (step, 1)
            index.insert(digest, live[digest])
    stored = exact_dedup.CuckooIndex.stored(index.dump())
    for one in (index, stored):
        assert one.resizes > 3 and {d: p for d, p in zip(one.digests, one.payloads, strict=True) if d is not None} == live
        assert all(one.get(d) == p for d, p in live.items())
    assert len(stored.digests) == len(live)
    # a fingerprint that collides is a filter hit, but not a live digest
    ghost = next(iter(live))[:10] + bytes(22)
    before = stored.false_hits
    assert stored.filter.hits(ghost) and stored.get(ghost) is None and stored.false_hits > before


def test_a_miss_of_the_filter_reads_no_key(spark):
    """Without the keys, new digests are still inserted, and an all-new probe is still answered."""
    index = exact_dedup.CuckooIndex(100)
    index.insert(bytes(range(32)), (1, 1))
    index.digests = [None]  # a lookup of the stored key would not find it
    other = bytes(range(1, 33))
    assert index.get(other) is None and index.false_hits == 0
    rows = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    table = exact_dedup.live_index(exact_dedup.digest_rows(rows(range(50))), keys_per_bucket=10)
    table = spark.createDataFrame(table.collect(), table.schema)
    broken = table.withColumn("digests", F.expr("transform(digests, x -> raise_error('a key was read'))")).select(table.columns)
    assert [r.keep_id for r in exact_dedup.probe(rows([1000, 1001]), broken).collect()] == [None, None]
    hits = exact_dedup.filter_hits(exact_dedup.digest_rows(rows(range(40, 60))).select("digest"), broken)
    assert 10 <= hits.count() <= 12
    with pytest.raises(Exception, match="a key was read"):
        exact_dedup.probe(rows([3]), broken).collect()


def test_exact_dedup(docs):
    same(exact_dedup.exact_dedup(docs).toPandas(), sql_rows(docs, oracles.EXACT))
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in docs.collect()})


def test_index_updates(spark):
    rows = lambda ids: spark.createDataFrame([(i, f"t{i % 7}") for i in ids], "doc_id long, text string")
    index = exact_dedup.live_index(exact_dedup.digest_rows(rows(range(20))), keys_per_bucket=7)
    index = spark.createDataFrame(index.collect(), index.schema)
    gone = exact_dedup.digest_rows(rows([1])).select("digest")
    more = exact_dedup.index_keys(exact_dedup.live_index(exact_dedup.digest_rows(rows(range(30, 36)))))
    updated = exact_dedup.update_index(index, more, gone)
    got = exact_dedup.index_keys(updated).collect()
    want = defaultdict(list)
    for i in [*(i for i in range(20) if i % 7 != 1), *range(30, 36)]:
        want[hashlib.sha256(f"t{i % 7}".encode()).digest()].append(i)
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in got} == {d: (max(x), len(x)) for d, x in want.items()}
    hits = exact_dedup.probe(rows([100, 3]).withColumn("text", F.when(F.col("doc_id") == 3, "t3").otherwise("new")), index).collect()
    assert {r.doc_id: r.keep_id for r in hits} == {100: None, 3: 17}
    # a bucket that outgrows its filter is refilled from its keys
    many = spark.createDataFrame([(i, f"many {i}") for i in range(3000)], "doc_id long, text string")
    grown = exact_dedup.update_index(updated, exact_dedup.index_keys(exact_dedup.live_index(exact_dedup.digest_rows(many))), gone)
    grown = spark.createDataFrame(grown.collect(), grown.schema)
    assert max(r.resizes for r in grown.collect()) > 3
    again = exact_dedup.probe(many, grown).collect()
    assert all(r.keep_id == r.doc_id for r in again) and len(again) == 3000


def test_groups_of_probes_and_updates_are_bounded(spark, monkeypatch):
    """Ten times more probes and insertions than keys, and one hot digest: no group outgrows its limit by much."""
    digests = lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    index = exact_dedup.live_index(exact_dedup.digest_rows(digests(f"t{k}" for k in range(200))), keys_per_bucket=300)
    index = spark.createDataFrame(index.collect(), index.schema)
    assert [r.buckets for r in index.collect()] == [1]
    asked = exact_dedup.digest_rows(digests([f"t{k}" for k in range(0, 2400, 2)])).select("digest")
    assert {bytes(r.digest) for r in exact_dedup.filter_hits(asked, index, part=100).collect()} >= {hashlib.sha256(f"t{k}".encode()).digest() for k in range(0, 200, 2)}
    dealt = exact_dedup.dealt_probes(asked, index, 100)[0].groupBy("bucket", "part").count().collect()
    groups = [r["count"] for r in dealt]
    assert sum(groups) == 1200 and max(groups) < 200
    hot = spark.sql("SELECT CAST('hot' AS BINARY) AS digest, id AS keep_id, 1L AS group_size FROM range(3000)")
    more = asked.select("digest", F.lit(7).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).unionByName(hot)
    grown = exact_dedup.update_index(index, more, asked.limit(0), keys_per_bucket=300)
    rows = grown.collect()
    sizes = [len(r.digests) for r in rows]
    assert sum(sizes) == 200 + 1100 + 1 and max(sizes) <= 300 and {r.buckets for r in rows} == {8}
    keys = {bytes(r.digest): (r.keep_id, r.group_size) for r in exact_dedup.index_keys(grown).collect()}
    assert keys[b"hot"] == (2999, 3000)
    assert keys[hashlib.sha256(b"t4").digest()] == (7, 2) and keys[hashlib.sha256(b"t5").digest()] == (5, 1) and keys[hashlib.sha256(b"t2398").digest()] == (7, 1)
    again = spark.createDataFrame(rows, grown.schema)
    found = {r.doc_id: r.keep_id for r in exact_dedup.probe(digests(["t4", "t2398", "new"]), again).collect()}
    assert found == {0: 7, 1: 7, 2: None}
    assert exact_dedup.filter_hits(asked.limit(0), index).count() == 0


def test_line_dedup(spark, docs):
    same(line_dedup_result(unique_ids(docs)), sql_rows(unique_ids(docs), oracles.LINES))
    draw, lines = random.Random(5), [f"line {k}" for k in range(6)] + ["", "  ", "\t"]
    rows = [(k, "\n".join(draw.choice(lines) for _ in range(draw.randrange(14)))) for k in range(120)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    same(line_dedup_result(many), sql_rows(many, oracles.LINES))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    # brute force
    seen, want = set(), {}
    for doc_id, text in rows:
        filled = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(filled) - 2):
            key = tuple(x for _, x in filled[k : k + 3])
            gone |= {k, k + 1, k + 2} if key in seen else set()
            seen.add(key)
        want[doc_id] = (len(filled), len(gone))
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(many).collect()} == want


def line_dedup_result(docs):
    found = line_dedup.dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256")).toPandas()


def test_quality_rules(spark, docs):
    same(quality.quality_rules(unique_ids(docs)).toPandas(), sql_rows(unique_ids(docs), oracles.oracle_sql()["op5_quality_rules"]))
    draw = random.Random(9)
    rows = [(k, " ".join(draw.choice("the a # <> of b\nc".split(" ")) for _ in range(draw.randrange(60)))) for k in range(150)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    same(quality.quality_rules(many).toPandas(), sql_rows(many, oracles.oracle_sql()["op5_quality_rules"]))
    assert quality.quality_rules(docs.limit(0)).count() == 0
    assert quality.quality_rules(docs).count() == docs.count()


def test_license_scan(spark, docs):
    draw, rows = random.Random(2), []
    for k in range(60):
        name, body = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = body.split()
        for _ in range(k % 3):  # light edits
            if len(words) > 30:
                words[draw.randrange(len(words))] = "changed"
        rows.append((k, f"{text_of(draw, k * 7)}\n{' '.join(words).upper()}\n{text_of(draw, k)}", name))
    rows += [(1000, None, None), (1001, "", None), (1002, text_of(draw, 500), None), (1003, "license " * 3000, None)]
    many = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = licenses.scan_licenses(many)
    same(got.toPandas(), sql_rows(many, oracles.oracle_sql()["op7_license_scan"]))
    assert {(r.doc_id, r.license_id) for r in got.collect()} >= {(k, n) for k, t, n in rows if n and k % 3 == 0}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs).count() == 0
    short = licenses.scan_licenses(many, [("two", "mit license"), ("long", " ".join(WORDS[:400]))])
    assert {r.license_id for r in short.collect()} == {"two"}
    with pytest.raises(ValueError):
        licenses.scan_licenses(many, [("empty", "...")])


def test_alignment_is_the_longest_chain():
    draw = random.Random(4)
    for _ in range(60):
        a = text_of(draw, draw.randrange(5, 80))
        b = mutated(draw, a, draw.choice([0, 0.02, 0.05]))
        x, y = order_minhash.kmers(a), order_minhash.kmers(b)
        table = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        exact = table[-1, -1] / (len(x) + len(y) - table[-1, -1])
        got = order_minhash.alignment_similarity(x, y)
        assert got == exact if exact >= 0.8 else got < 0.8


def test_components_are_the_least_labels(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 900), (200, 201)]
    rows = [*edges, *edges, (201, 200), (None, 5), (5, None)]
    with Scratch(spark, "test") as scratch:
        got = {r.node: r.label for r in components.components(spark.createDataFrame(rows, "a long, b long"), scratch).collect()}
        assert components.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    assert got == {n: 1 if n < 42 or n == 900 else 100 if n < 160 else 200 for e in edges for n in e}


def near_classes(rows):
    """Brute force: components of all pairs at 0.8 or more, by least id."""
    found = {k: order_minhash.kmers(t) for k, t in rows}
    label = {k: k for k in found}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if order_minhash.alignment_similarity(found[a], found[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in ids}


def test_near_duplicates(spark, docs):
    draw, rows = random.Random(11), []
    passage = text_of(draw, 80)
    for group in range(25):
        base = text_of(draw, draw.randrange(20, 300))
        for copy in range(draw.choice([1, 1, 2, 5])):
            rows.append((len(rows), mutated(draw, base, 0.01 * copy)))
    base = text_of(draw, 150)
    rows += [(len(rows) + k, mutated(draw, base, 0.02)) for k in range(60)]  # a large group around one text
    rows += [(len(rows) + k, f"{passage} {text_of(draw, 40)}") for k in range(60)]  # a passage that many share
    rows += [(5000, "one two three"), (5001, "One, two; three"), (5002, "three two one")]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(many).collect()}
    assert got == near_classes(rows)
    assert order_minhash.near_duplicates(docs.limit(0)).count() == 0
    own = order_minhash.near_duplicates(docs).collect()
    assert len(own) == docs.count()
    assert {r.doc_id: r.class_id for r in own if r.doc_id in (0, 1, 2, 3)} == {0: 0, 1: 0, 2: 2, 3: 3}
    kept = order_minhash.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 2, 3, 4, 5, 6, 7]


def test_near_duplicates_within_a_family(spark):
    """Pairs at 0.8 whose shared bands all lie in a passage that a family shares."""
    draw, rows, planted = random.Random(23), [], 0
    passage = text_of(draw, 300)
    bands = lambda text: set(order_minhash.sketch(order_minhash.kmers(text)).tolist())
    while planted < 12:
        more = text_of(draw, 58)
        pair = [f"{passage} {more} {text_of(draw, 42)}" for _ in range(2)]
        if bands(pair[0]) & bands(pair[1]) <= bands(passage):
            rows += [(len(rows) + k, text) for k, text in enumerate(pair)]
            planted += 1
    rows += [(len(rows) + k, f"{passage} {text_of(draw, 100)}") for k in range(60)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_classes(rows)
    assert len(set(want.values())) == len(rows) - planted
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(many).collect()} == want


def test_open_pairs_join_all_classes(spark):
    """From no classes at all, the pairs alone give the classes of brute force, whichever k-mers count as common."""
    draw, rows = random.Random(29), []
    parts = [text_of(draw, 40) for _ in range(6)]
    for k in range(60):
        rows.append((len(rows), " ".join(draw.sample(parts, 4)) + " " + text_of(draw, 1 + k % 30)))
        rows.append((len(rows), mutated(draw, " ".join(parts), 0.002 * (k % 10))))
    rows += [(1000, "one two three"), (1001, "one two three four five six seven eight nine ten"), (1002, "one two three four five six seven eight nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, want = {k: order_minhash.kmers(t) for k, t in rows}, near_classes(rows)
    with Scratch(spark, "test") as scratch:
        nodes = scratch.write(order_minhash.sketch_rows(docs).dropDuplicates(["node"]), "nodes")
        labels, rep = nodes.select("node", "n", "odd", F.col("node").alias("label")), {r.node: r.doc_id for r in nodes.collect()}
        for common in (1, 8, 64):
            label = {k: k for k in rep.values()}
            for a, b in order_minhash._open_pairs(labels, nodes, common, scratch).collect():
                x, y = label[rep[a]], label[rep[b]]
                if x != y and order_minhash.alignment_similarity(found[rep[a]], found[rep[b]]) >= 0.8:
                    label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
            assert label == {k: want[k] for k in label}


def test_possible_pairs_hold_all_at_the_threshold(spark):
    """The bounds before alignment set aside no pair at 0.8."""
    draw, rows = random.Random(31), []
    for k in range(40):
        base = text_of(draw, draw.choice([3, 9, 40, 200, 900]))
        rows += [(len(rows) + c, mutated(draw, base, rate)) for c, rate in enumerate((0, 0.002, 0.005, 0.01, 0.03))]
    nodes = order_minhash.sketch_rows(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["node"])
    nodes = nodes.withColumn("family", F.floor(F.col("doc_id") / 5))
    a, b = (order_minhash._sided(nodes, x, ["doc_id", "family", "n", "odd"]) for x in ("a", "b"))
    pairs = a.join(b, F.expr("family_a = family_b AND doc_id_a < doc_id_b")).withColumn("possible", order_minhash._possible("a", "b")).collect()
    found = {k: order_minhash.kmers(t) for k, t in rows}
    near = [order_minhash.alignment_similarity(found[r.doc_id_a], found[r.doc_id_b]) >= 0.8 for r in pairs]
    assert sum(near) > 80 and all(r.possible for r, x in zip(pairs, near, strict=True) if x)
    assert sum(not r.possible for r in pairs) > 20


def test_rows_of_a_family_grow_in_proportion(spark, monkeypatch):
    """Four times the texts of one group, of which few pairs reach 0.8, make about four times the rows in every table."""
    write, made = Scratch.write, defaultdict(list)

    def counted(self, df, name):
        out = write(self, df, name)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    draw, totals = random.Random(37), []
    base = text_of(draw, 120)
    for size in (250, 1000):
        made.clear()
        rows = [(k, mutated(draw, base, 0.025)) for k in range(size)]
        order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
        totals.append({name: sum(x) for name, x in made.items()})
    small, large = totals
    assert all(large[name] <= 6 * small[name] + 500 for name in small if name in large), (small, large)


def test_one_row_of_each_class_stays(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    draw = random.Random(41)
    one, other, third = (text_of(draw, 100) for _ in range(3))
    rows = [(1, one), (1, one), (1, one + " more"), (2, one), (1, other), (3, other + " more"), (None, third), (None, third + " more"), (None, third), (None, None), (None, ""), (4, None), (4, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, node int")
    kept = order_minhash.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 6 and sum(t is not None and t.startswith(third) for _, t in got) == 1
    assert sum(t is not None and t.startswith(one) for _, t in got) == sum(t is not None and t.startswith(other) for _, t in got) == 1
    assert {(4, None), (None, None), (None, "")} <= set(got)


def test_a_text_of_several_megabytes(spark):
    long = text_of(random.Random(43), 600_000)
    rows = [(1, long), (2, long + " end"), (3, "short " * 8)]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_language_identification(spark, docs, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(whole).join(whole, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == whole.count() and 20 < len(held) < 80
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.fit(whole)
    de, en = (next(r.text for r in got if r.lang == x and r.n_chars > 3000)[:1500] for x in ("de", "en"))
    mixed = spark.createDataFrame([(1, de + en), (2, "123 !!"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(mixed, model).collect()}
    assert set(out[1].lang_shares) == {"de", "en"} and 0.3 < out[1].lang_shares["de"] < 0.7
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (2, 3, 4))
    assert langid.identify(docs).count() == docs.count()
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_language_mixture_equals_plain_em(spark):
    """Shares against a plain EM with the same order of leaving, and the set against all sets of languages."""
    from itertools import combinations

    draw, langs = random.Random(53), ["aa", "bb", "cc"]
    words = {x: ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 8))) for _ in range(80)] for x, letters in zip(langs, ("abcdefgh", "efghijkl", "ijklmnab"), strict=True)}
    say = lambda x, n: " ".join(draw.choice(words[x]) for _ in range(n))
    train = spark.createDataFrame([(say(x, 60), x) for x in langs for _ in range(30)], "text string, lang string")
    model = langid.fit(train)
    texts = [" ".join(say(x, n) for x, n in zip(langs, sizes, strict=True) if n) for sizes in [(30, 0, 0), (0, 9, 0), (20, 20, 0), (5, 0, 40), (12, 12, 12), (1, 0, 0), (0, 3, 60), (40, 30, 20)]]

    def em(units, allowed, shares):
        norm = lambda s: [max(s[k], 1e-6) / sum(max(s[j], 1e-6) for j in allowed) if k in allowed else 0.0 for k in range(len(langs))]
        shares = norm(shares)
        for step in range(langid.STEPS + 1):
            likely = [[math.exp(u[k]) * shares[k] for k in range(len(langs))] for u in units]
            if step == langid.STEPS:
                return shares, sum(math.log(sum(x)) for x in likely)
            shares = norm([sum(x[k] / sum(x) for x in likely) / len(units) for k in range(len(langs))])

    found = langid.predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    agreed = 0
    for row in found:
        grams = langid.ngrams(row.text)
        units = [[float(sum(float(model[x][g]) for g in grams[at : at + langid.UNIT])) for x in langs] for at in range(0, len(grams), langid.UNIT)]
        units = [[v - max(u) for v in u] for u in units]
        cost = langid.PENALTY * math.log(max(len(units), 2)) / 2
        allowed = [0, 1, 2]
        shares, fit = em(units, allowed, [1 / 3] * 3)
        while len(allowed) > 1:
            fewer = [k for k in allowed if k != max(allowed, key=lambda k: (-shares[k], k))]
            trial, lower = em(units, fewer, shares)
            if lower + cost < fit:
                break
            allowed, shares, fit = fewer, trial, lower
        got = [row.lang_shares.get(x, 0.0) for x in langs]
        assert all(abs(a - b) < 1e-3 for a, b in zip(got, shares, strict=True)), (got, shares)
        sets = [list(c) for n in (1, 2, 3) for c in combinations(range(3), n)]
        best = max(sets, key=lambda c: em(units, c, [1 / len(c) if k in c else 0.0 for k in range(3)])[1] - cost * len(c))
        agreed += best == allowed
    assert agreed >= len(texts) - 1
    tied = langid.predict(spark.createDataFrame([(1, "zzz")], "doc_id long, text string"), {"b": np.zeros(langid.BUCKETS, np.float32), "a": np.zeros(langid.BUCKETS, np.float32)})
    assert tied.first().lang_pred == "a"


def test_language_of_a_long_text(spark, docs):
    long = "The quick fox. It's a line, the word isn't. " * 60_000
    model = langid.fit(docs)
    got = langid.predict(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "en", 2: "und"}


def test_tied_languages(spark):
    """Of languages with the same training texts the first that sorts is the prediction, whatever the order of the rows."""
    draw = random.Random(67)
    texts = [text_of(draw, 40) for _ in range(5)]
    for langs in (("bb", "aa", "cc"), ("cc", "bb", "aa")):
        train = spark.createDataFrame([(t, x) for x in langs for t in texts], "text string, lang string")
        asked = spark.createDataFrame([(1, texts[0]), (2, "strange words"), (3, "1 2")], "doc_id long, text string")
        assert {r.doc_id: r.lang_pred for r in langid.predict(asked, langid.fit(train)).collect()} == {1: "aa", 2: "aa", 3: "und"}


def test_toxicity(spark, docs, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    whole, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_toxicity(whole, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    ranks = held.score.rank()
    toxic = held.toxic == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.96
    caught, alarms = (held.predicted[toxic] == 1).mean(), (held.predicted[~toxic] == 1).mean()
    assert caught > 0.85 and alarms < 0.02, (caught, alarms)
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.0}
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    assert toxicity.score_toxicity(whole, odd).count() == whole.count()


def test_kneser_ney_equals_dictionaries(spark):
    """The tables against plain dictionaries, from the counts that Spark makes."""
    texts = [("a x b x c x", 1), ("a y a y", 1), ("a y z", 1), ("a x y", 0), ("b z x", 0), ("b z y a", 0), ("b z", 0), ("", 0)]
    rows = [(toxicity.word_slots(t).astype("<i4").tobytes(), label) for t, label in texts]
    model = toxicity.KneserNey(toxicity.count_pairs(spark.createDataFrame(rows, "words binary, toxic int")))
    slot = {w: int(toxicity.word_slots(w)[0]) for w in "abcxyz"}
    counts = {c: defaultdict(int) for c in (0, 1)}
    for t, label in texts:
        for pair in set(zip(["<s>", *t.split()], t.split(), strict=False)):
            counts[label][pair] += 1
    contexts = {c: {w: len({p for p, x in counts[c] if x == w}) for w in slot} for c in (0, 1)}

    def less(values):
        ones, twos = (sum(v == k for v in values) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    both = sum(contexts[c][w] for c in (0, 1) for w in slot) + 0.5 * toxicity.WORD_SLOTS
    for c in (0, 1):
        off, off_lower = less(counts[c].values()), less(contexts[c].values())
        mass, kinds = sum(contexts[c].values()), sum(n > 0 for n in contexts[c].values())
        lower = {w: (max(n - off_lower, 0) + off_lower * kinds * (contexts[0][w] + contexts[1][w] + 0.5) / both) / mass for w, n in contexts[c].items()}
        for prev in {p for p, _ in counts[c]} - {"<s>"}:
            after = {w: n for (p, w), n in counts[c].items() if p == prev}
            for word in slot:
                total = sum(after.values())
                want = max(after.get(word, 0) - off, 0) / total + off * len(after) / total * lower[word]
                found = model.find(toxicity.pair_keys(np.array([slot[prev], slot[word]])))[1]
                assert (found >= 0) == any((prev, word) in counts[k] for k in (0, 1))
                got = (model.pair[c, found] if found >= 0 else 0) / model.total[c, slot[prev]] + model.backoff[c, slot[prev]] * model.lower[c, slot[word]]
                assert abs(got - want) < 1e-5


def test_no_pair_is_lost_above_the_slots(spark, monkeypatch):
    """More pairs than ranges of the index: every pair keeps its own counts, and unseen pairs are not taken for others."""
    monkeypatch.setattr(toxicity, "PAIR_BITS", 6)
    draw = random.Random(3)
    texts = [(text_of(draw, 40), k % 2) for k in range(60)]
    rows = [(toxicity.word_slots(t).astype("<i4").tobytes(), label) for t, label in texts]
    counts = toxicity.count_pairs(spark.createDataFrame(rows, "words binary, toxic int"))
    model = toxicity.KneserNey(counts)
    want = [defaultdict(int), defaultdict(int)]
    for t, label in texts:
        for key in set(toxicity.pair_keys(toxicity.word_slots(t)).tolist()):
            want[label][key] += 1
    assert len(counts.slot) == len({*want[0], *want[1]}) > 30 * 2**6
    for label in (0, 1):
        ones, twos = (sum(n == k for n in want[label].values()) for k in (1, 2))
        assert counts.less[label] == toxicity.discount(ones, twos)
        keys = np.array([*want[label]])
        assert np.allclose(model.pair[label, model.find(keys)], np.array([*want[label].values()]) - counts.less[label])
        after = defaultdict(int)
        for key, n in want[label].items():
            after[key >> 20] += n
        assert all(model.total[label, w] == n for w, n in after.items())
    strange = toxicity.pair_keys(toxicity.word_slots("never seen together"))
    assert (model.find(strange) == -1).all()


def test_toxicity_of_odd_texts(spark, docs):
    """Null, empty, very long, repeated and tied texts get a score in 0..1 by a fitted model."""
    draw = random.Random(47)
    rows = [(k, text_of(draw, 60) + (" vile rotten" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100, text_of(draw, 700_000)), (101, "vile rotten"), (102, "vile rotten")], "doc_id long, text string"))
    got = toxicity.predict(odd, model).collect()
    assert len(got) == docs.count() + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if not r.text}) == 1 and len({r.score for r in got if r.text == "vile rotten"}) == 1
    assert all(r.predicted == 1 for r in got if r.text == "vile rotten")
    again = toxicity.fit(labelled.select("doc_id", "text").repartition(5), labelled.select("doc_id", "toxic").repartition(3))
    assert (again.weights == model.weights).all() and (again.pair == model.pair).all()
