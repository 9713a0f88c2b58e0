import random

from pyspark.sql import functions as F

from spanwise.llm import lines
from spanwise.llm.lines import dedup_lines, removed_lines
from spanwise.llm.queries import op1_line_dedup


def distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(docs, min_chars, edits=1):
    every = sorted(((i, p, ln) for i, t in docs if t is not None for p, ln in enumerate(t.split("\n")) if len(ln) >= min_chars), key=lambda r: r[:2])
    gone, near = set(), set()
    for k, (i, p, ln) in enumerate(every):
        d = [distance(ln, o) for _, _, o in every[:k]]
        if d and min(d) <= edits:
            gone.add((i, p))
            if min(d) == 1:
                near.add((i, p))
    out = {}
    for i, t in docs:
        ls = [] if t is None else t.split("\n")
        out[i] = (None if t is None else "\n".join(ln for p, ln in enumerate(ls) if (i, p) not in gone), len(ls), sum(g[0] == i for g in gone), sum(g[0] == i for g in near))
    return out


def edit(rng, s):
    i = rng.randrange(len(s) + 1)
    return rng.choice([s[:i] + rng.choice("ab ") + s[i:], s[: max(i - 1, 0)] + s[i:], s[: max(i - 1, 0)] + rng.choice("abé") + s[i:]])


def check(spark, docs, min_chars):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, _pos string, n_lines int").repartition(3)
    got = {r["doc_id"]: r for r in dedup_lines(df, min_chars=min_chars).collect()}
    want = plain(docs, min_chars)
    assert len(got) == len(docs)
    for i, w in want.items():
        g = got[i]
        assert (g["text"], *g["line_dedup"]) == w, i
        assert (g["_pos"], g["n_lines"]) == ("k", 1)


def test_lines_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é") for _ in range(n)) for n in (1, 2, 3, 5, 31, 32, 33, 34, 63, 64, 65, 66, 97, 200)]
    docs = [(i, "\n".join(rng.choice([lambda s: s, lambda s: edit(rng, s), lambda s: edit(rng, edit(rng, s))])(rng.choice(base)) for _ in range(rng.randrange(1, 7)))) for i in range(90)]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "x" * 5000 + "\n" + "x" * 5001), (1004, "x" * 4999 + "y")]
    rng.shuffle(docs)
    check(spark, docs, 1)
    check(spark, docs, 20)


def test_repeated_rows_and_null_ids(spark):
    a, b = "a line that is long enough to count", "a line that is long enough to count!"
    rows = [(5, a), (5, a), (None, a + "\nkeep"), (None, "another line, also long enough here"), (7, b), (2, "z" * 30)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 99), r["text"], r["line_dedup"]["n_removed"]) for r in got) == [
        (2, "z" * 30, 0),
        (5, a, 0),
        (5, a, 0),
        (7, "", 1),
        (99, "another line, also long enough here", 0),
        (99, "keep", 1),
    ]


def test_no_documents(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounds_of_two_and_more(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("ab é") for _ in range(n)) for n in (1, 2, 4, 9, 20, 29, 30, 31, 59, 61, 90)]
    docs = []
    for i in range(60):
        some = []
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(base)
            for _ in range(rng.randrange(0, 6)):
                s = edit(rng, s)
            some.append(s)
        docs.append((i, "\n".join(some)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    every = [(i, p, ln) for i, t in docs for p, ln in enumerate(t.split("\n"))]
    for how, k in (({"edits": 2}, lambda n: 2), ({"edits": 3}, lambda n: 3), ({"edits": 2, "per": 30, "most": 4}, lambda n: min(4, 2 + n // 30))):
        for least in (1, 20) if how == {"edits": 2} else (1,):
            rows = [r for r in every if len(r[2]) >= least]
            want = {}
            for at, (i, p, ln) in enumerate(rows):
                by = [o[:2] for o in rows[:at] if levenshtein(ln, o[2]) <= k(min(len(ln), len(o[2])))]
                if by:
                    want[i, p] = by[0]
            got = removed_lines(df, min_chars=least, **how).collect()
            assert {(r["_doc"], r["_pos"]): (r["_by"]["_doc"], r["_by"]["_pos"]) for r in got} == want
            assert len(got) == len(want) > 20


def test_short_lines_go_when_equal(spark):
    docs = spark.createDataFrame([(1, "Menu\nlonger line that is kept, number 1\n\n \t"), (2, "Menu\nMenus\n\n \t"), (3, "Menu"), (4, "a" * 19 + "\n" + "a" * 18 + "b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["line_dedup"]["n_removed"], r["line_dedup"]["n_near"]) for r in dedup_lines(docs, edits=2, least=1).collect()}
    assert got == {1: ("Menu\nlonger line that is kept, number 1\n\n \t", 0, 0), 2: ("Menus\n\n \t", 1, 0), 3: ("", 1, 0), 4: ("a" * 19 + "\n" + "a" * 18 + "b", 0, 0)}


def test_query_removes_short_and_near_lines(spark, tmp_path):
    docs = [(1, "Menu\nthe quick brown fox jumps over the dog"), (2, "Menu\nthe quick brown fix jumps over the dogs"), (3, "Menu")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_near"], r["kept_chars"]) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0, 43), 2: (2, 1, 0), 3: (1, 0, 0)}


def test_keys_with_many_pairs_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", 3)
    rng = random.Random(5)
    base = ["a common start of many lines, then " + "".join(rng.choice("ab") for _ in range(n)) + " and a common end of them" for n in (4, 9, 30)]
    docs = [(i, edit(rng, rng.choice(base) if i % 3 else edit(rng, rng.choice(base)))) for i in range(45)]
    docs += [(100 + i, edit(rng, "x" * 25)) for i in range(5)]
    got = removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=1, edits=2).collect()
    want = {}
    for at, (i, ln) in enumerate(docs):
        by = [o for o, other in docs[:at] if levenshtein(ln, other) <= 2]
        if by:
            want[i, 0] = by[0]
    assert {(r["_doc"], r["_pos"]): r["_by"]["_doc"] for r in got} == want
    assert len(want) > 20


def test_distance_and_letters_agree_with_levenshtein(spark):
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), ("same", "same"), ("aaaa", "aa"), ("abab" * 200, "abab" * 200 + "b"), ("x" * 3000 + "y", "z" + "x" * 3000)]
    for _ in range(400):
        a = "".join(rng.choice("abeé𝄞 ") for _ in range(rng.randrange(40)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "𝄞", "te"])
        pairs.append((a, "".join(b)))
    d = spark.createDataFrame(pairs, "a string, b string")
    moved = F.aggregate(F.zip_with(lines.letters(F.col("a")), lines.letters(F.col("b")), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    whole = F.levenshtein("a", "b")
    assert d.filter(lines.distance(F.col("a"), F.col("b"), 4) != F.levenshtein("a", "b", 4)).isEmpty()
    assert d.filter(moved > 2 * whole).isEmpty()


def test_an_edit_changes_two_bits_of_the_marks(spark):
    rng = random.Random(8)
    pairs = [("e" * 40, "e" * 23), ("", "é"), ("a b", "ab")]
    for _ in range(300):
        a = "".join(rng.choice("abeqz é𝄞T ") for _ in range(rng.randrange(60)))
        b = a
        for _ in range(rng.randrange(5)):
            b = edit(rng, b)
        pairs.append((a, b))
    mark = lambda c: lines.marks(F.col(c), F.lit(2))
    bits = sum((F.bit_count(mark("a")[k].bitwiseXOR(mark("b")[k])) for k in ("x", "y")), F.lit(0))
    d = spark.createDataFrame(pairs, "a string, b string").select(bits.alias("bits"), F.levenshtein("a", "b").alias("apart"))
    assert d.filter("bits > 2 * apart").isEmpty() and not d.filter("bits = 2 * apart and apart = 4").isEmpty()


def test_pairs_of_a_template_are_mostly_ruled_out_without_their_texts(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "river", "mound", "cloak", "sparrow", "of", "quince", "zebra", "fly", "jug"]
    docs = [(i, "a common start of many lines " + " ".join(rng.choice(words) for _ in range(8)) + " and a common end") for i in range(60)]
    docs.append((60, docs[7][1].replace("start", "stark")))
    kept, asked = lines.cut, []

    def seen(df):
        out = kept(df)
        if out.columns == ["_one", "_two"]:
            asked.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut", seen)
    got = removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits=2).collect()
    assert {(r["_doc"], r["_by"]["_doc"]) for r in got} == {(60, 7)}
    assert 1 <= sum(asked) <= 60 and asked


def test_a_large_group_of_near_lines_is_no_square(spark, monkeypatch):
    text = "a long line that many documents repeat with one number that differs, here it is: "
    docs = [(i, f"{text}{i % 10}{i // 10} and the end") for i in range(90)]
    docs.append((90, docs[3][1].replace("long", "lung").replace("03", "30")))
    kept, asked = lines.cut, []

    def seen(df):
        out = kept(df)
        if out.columns[:2] == ["_one", "_two"]:
            asked.append(out.select("_one", "_two").distinct().count())
        return out

    monkeypatch.setattr(lines, "cut", seen)
    got = removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits=2).collect()
    want = {}
    for at, (i, ln) in enumerate(docs):
        by = [o for o, other in docs[:at] if levenshtein(ln, other) <= 2]
        if by:
            want[i] = by[0]
    assert {r["_doc"]: r["_by"]["_doc"] for r in got} == want
    assert len(want) >= 89 and sum(asked) <= 4 * len(docs)


def test_a_family_of_lines_is_compared_by_marks_and_not_cut_again_and_again(spark, monkeypatch):
    rng = random.Random(9)
    words = [rng.choice(["river", "mound", "cloak", "raven", "quill"]) for _ in range(14)]
    docs = []
    for i in range(90):
        w = list(words)
        for _ in range(3):
            w[rng.randrange(5, 9)] = rng.choice(["zebra", "fudgy", "whisk", "ocean"])
        docs.append((i, " ".join(w)))
    docs += [(90 + i, edit(rng, docs[i][1])) for i in range(10)]
    cutting = []
    monkeypatch.setattr(lines, "finer", lambda *a, f=lines.finer: cutting.append(1) or f(*a))
    got = removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits=2).collect()
    want = {}
    for at, (i, ln) in enumerate(docs):
        by = [o for o, other in docs[:at] if abs(len(ln) - len(other)) <= 2 and levenshtein(ln, other) <= 2]
        if by:
            want[i] = by[0]
    assert {r["_doc"]: r["_by"]["_doc"] for r in got} == want
    assert len(want) >= 10 and not cutting


def test_texts_of_candidate_lines_are_dealt_once(spark):
    rows = spark.createDataFrame([(i % 9, i // 9, 0, f"{'a' * (i % 9)} line that some have") for i in range(36)], "_a long, _doc long, _pos int, _line string").withColumn("_hash", F.xxhash64("_doc"))
    keys = spark.range(9).select(F.col("id").alias("_a"), F.lit(1).cast("long").alias("_key"))
    texts = lines.candidates(rows, keys)
    assert texts.count() == 9
    pairs = spark.range(9).filter("id > 0").select((F.col("id") - 1).alias("_one"), F.col("id").alias("_two"))
    near = lines.near_of(pairs, texts, 2, 0, 2)
    assert {(r["_one"], r["_two"]) for r in near.collect()} == {(i, i + 1) for i in range(8)}
    plan = texts.join(pairs.withColumnRenamed("_two", "_a").hint("shuffle_merge"), "_a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the pairs
