import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontamination, lexical_search, oracles, spelling
from tideline.session import Scratch


def sql_rows(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        frame = df.select(F.col(df.columns[0]), "text").toPandas()
        frame[df.columns[0]] = frame[df.columns[0]].astype("Int64")
        con.register(name, frame)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return Counter(tuple(sorted(zip(names, map(str, row), strict=True))) for row in found.fetchall())


def rows_of(df):
    return Counter(tuple(sorted((n, str(row[n])) for n in df.columns)) for row in df.collect())


def digested(found):
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@pytest.fixture
def items(spark):
    draw = random.Random(11)
    passage = lambda n: " ".join(f"k{draw.randrange(40)}" for _ in range(n))
    texts = ["The the quick fox.", "word " * 12, None, "", "...", "漢字 É é", "word", passage(10), passage(30), passage(11), "No ID here!", passage(30)]
    texts.append(texts[8])
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "item_id long, text string, doc_id string")


def planted(spark, items):
    """Texts of few words with whole items, item parts and edited items in them."""
    draw, texts = random.Random(3), [r.text for r in items.collect() if r.text]
    out = []
    for k in range(150):
        words = [f"k{draw.randrange(40)}" for _ in range(draw.randrange(60))]
        for text in draw.sample(texts, 2):
            own = text.split()
            cut = own[draw.randrange(3) :][: draw.randrange(4, 32)]
            if k % 3 == 0 and cut:
                cut[draw.randrange(len(cut))] = "edited"
            at = draw.randrange(len(words) + 1)
            words[at:at] = [w.upper() if k % 2 else w for w in cut]
        out.append((k, (" " if k % 4 else ", ").join(words)))
    return spark.createDataFrame(out, "doc_id long, text string")


def unique_ids(docs):
    return docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def test_decontamination(spark, docs, items):
    for own in (unique_ids(docs), planted(spark, items)):
        assert rows_of(digested(decontamination.decontaminate(own, items))) == sql_rows(oracles.DECONTAMINATION, documents=own, benchmark=items)
    got = decontamination.decontaminate(docs, items)
    assert got.count() == docs.count()
    twice = [r for r in got.collect() if r.doc_id == 6]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_hit == 5000
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).filter("contaminated OR n_items > 0").count() == 0
    nameless = items.withColumn("item_id", F.lit(None).cast("long"))
    assert decontamination.decontaminate(docs, nameless).filter("doc_id = 6 AND n_hit = 5000 AND n_items = 0").count() == 2


def test_decontamination_with_a_full_bitmap(spark, items, monkeypatch):
    """Shingles that are no item's pass a bitmap that is too small; they change no result."""
    monkeypatch.setattr(decontamination, "LARGEST", 4)
    monkeypatch.setattr(decontamination, "BITS", 0.01)
    own = planted(spark, items)
    assert rows_of(digested(decontamination.decontaminate(own, items))) == sql_rows(oracles.DECONTAMINATION, documents=own, benchmark=items)


def test_a_frequent_shingle_gives_no_product(spark):
    """Many windows and many texts share a shingle; rows grow with both, not with their product."""
    common = "one two three four five"
    items = spark.createDataFrame([(k, f"a{k} b{k} {common} c{k} d{k} e{k}") for k in range(300)], "item_id long, text string")
    own = spark.createDataFrame([(k, f"x{k} a{k} b{k} {common} c{k} d{k} e{k} y{k}") for k in range(300)], "doc_id long, text string")
    with Scratch(spark, "test") as scratch:
        _, met = decontamination.occurrences(own, decontamination.windows_of(items), scratch)
        assert met.count() == 300
    assert decontamination.decontaminate(own, items).filter("n_hit = 10 AND n_items = 1").count() == 300


def test_lexical_search(spark, docs, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 7)
    for own in (unique_ids(docs), planted(spark, items)):
        want = sql_rows(oracles.SEARCH, documents=own, benchmark=items)
        assert rows_of(lexical_search.search(own, items)) == want
        monkeypatch.setattr(lexical_search, "ITEM_BYTES", 40)  # many blocks of items
        assert rows_of(lexical_search.search(own, items)) == want
        monkeypatch.setattr(lexical_search, "ITEM_BYTES", 4 << 20)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_lexical_search_ties(spark):
    docs = spark.createDataFrame([(k, "same words") for k in [5, 3, None, 9, 3, 1, 7, 8, 2, 4, 6, 0]], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words"), (1, "words"), (1, "same"), (None, "words words")], "item_id long, text string")
    got = defaultdict(list)
    for r in lexical_search.search(docs, items, top=12).orderBy("rank").collect():
        got[r.item_id, r.score].append(r.doc_id)
    ids = [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, None]
    assert sorted(got.values(), key=len) == [ids, sorted([*ids, *ids], key=lambda x: (x is None, x))] and len(got) == 2


def plain_spelling(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    out, form = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(around))
    roots = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        roots[w] = root
    return {(w, form[w], roots[w], n, k, words[form[w]] if form[w] else None) for w, (n, k) in out.items()}


def spelled(df):
    return {tuple(r) for r in spelling.group_spellings(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_variants(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 3)
    monkeypatch.setattr(spelling, "SHARD_KEYS", 40)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 20)
    monkeypatch.setattr(spelling, "PAIRS", 30)
    draw, rows = random.Random(4), [(r.doc_id, r.text) for r in docs.collect()]
    stems = ["abcabca", "aaaaaaa", "Éclairée", "interest", "internal", "÷×÷×÷×÷", "z" * 60]
    for k in range(200):
        words = []
        for _ in range(30):
            word = list(draw.choice(stems))
            for _ in range(draw.choice([0, 0, 0, 1, 2, 3])):
                at = draw.randrange(len(word))
                word[at : at + draw.randrange(2)] = draw.choice(["", "a", "b", "é"])
            words.append("".join(word))
        rows.append((k + 100, " ".join(words)))
    rows += [(400 + k, "chainword " * 10**k + "chainwords " * 10 ** (k + 1)) for k in range(3)] + [(None, "nothing nothing goes goesaway")]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelled(many) == plain_spelling(rows)
    assert spelled(many.limit(0)) == set()


def test_words_with_one_segment_in_common_form_no_pairs(spark):
    """A third and more of all words share their first half; candidates stay in proportion to the words."""
    draw, sizes = random.Random(8), []
    for size in (400, 1600):
        words = {"segment" + "".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(size)}
        with Scratch(spark, "test") as scratch:
            own = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
            keys, probes = spelling.bounded_keys(own, scratch)
            scanned = probes.groupBy(*spelling.KEY).agg(F.count(F.lit(1)).alias("p")).join(keys.groupBy(*spelling.KEY).agg(F.count(F.lit(1)).alias("k")), spelling.KEY)
            assert keys.groupBy(*spelling.KEY).count().filter(F.col("e") - F.col("s") > 1).agg(F.max("count")).first()[0] <= spelling.GROUP
            sizes.append(scanned.agg(F.sum(F.col("p") * F.col("k"))).first()[0])
    assert sizes[1] < 8 * sizes[0]


def test_one_edit_of_long_words():
    word = "x" * 30 + "y" * 40
    other = word[:35] + "z" + word[35:]
    shard = spelling.Shard([word, word], [3, 3], [(70, 35, 70, word[:35], ""), (70, 0, 35, "", word[35:])])
    spans = shard.candidates(other)
    owner, row = shard.near([other], np.zeros(sum(b - a for a, b in spans), dtype=np.int64), np.concatenate([np.arange(a, b) for a, b in spans]))
    assert len(row) == 1
