"""Near-duplicate operators against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import components, line_dedup, minhash_dedup, rp_forest
from quillspark.llm.components import connected_components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, i):
        self.up.setdefault(i, i)
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(100)]
    hub = [(500, i) for i in range(501, 700)]
    rest = [(random.randrange(1000, 1400), random.randrange(1000, 1400)) for _ in range(300)]
    edges = chain + hub + rest + [(5, 5), (None, 3), (3, None)]
    u = Union()
    for a, b in chain + hub + rest:
        u.join(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    for n in u.up:
        assert got.get(n, n) == u.find(n)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_copies(seed=1):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(1, 150))
        for _ in range(random.randint(1, 14)):
            own = [random.choice(vocabulary) if random.random() < random.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            docs.append(" ".join(own))
    return list(enumerate(docs)) + [(900, docs[0].upper()), (901, "")]


@pytest.mark.parametrize("size,percent,bucket,block", [(3, 85, 4096, 10**6), (5, 80, 4096, 10**6), (3, 85, 3, 10**6), (3, 85, 4096, 300)])
def test_minhash_equals_brute_force(spark, size, percent, bucket, block):
    """The last cases make buckets too large for a task and deal soft groups into many blocks."""
    docs = near_copies()
    sets = {i: shingle_set(t, size) for i, t in docs}
    u = Union()
    for i, x in sets.items():
        u.find(i)
        for j, y in sets.items():
            if i < j and x and 100 * len(x & y) >= percent * len(x | y):
                u.join(i, j)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df, size=size, percent=percent, bucket_most=bucket, block_shingles=block).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), u.find(r["doc_id"]), u.find(r["doc_id"]) == r["doc_id"])


def test_minhash_edges(spark, messy, nothing):
    got = minhash_dedup.near_duplicates(messy).collect()
    assert len(got) == 12
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[6]["component_id"], by_id[6]["kept"], by_id[1]["kept"]) == (1, False, True)
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert [by_id[i]["n_shingles"] for i in (2, 3, 4, 5, 7, 8, 10)] == [0, 0, 0, 1, 1, 1, 1]
    assert all(by_id[i]["component_id"] == i for i in (2, 3, 4))
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def words(line):
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", line.lower()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_corpus():
    random.seed(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "12", "Ärger", "naïve"]
    base = [" ".join(random.choices(vocabulary, k=random.randint(1, 40))) for _ in range(30)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(random.randint(1, 6)):
            line = random.choice(base)
            if random.random() < 0.4:
                place = random.randrange(len(line))
                line = line[:place] + random.choice("xyz,. ") + line[place:]
            if random.random() < 0.2:
                line = line.upper() + "!!"
            own.append(line)
        docs.append((i, "\n".join(own + random.choice([[], [""], ["---"]]))))
    return docs


def test_line_dedup_never_links_unlike_lines(spark):
    """Every link of the result is one of edit similarity alone; equal lines, and each kind of line that has one edit, are found."""
    docs, similarity = line_corpus(), 0.9
    norms = {}
    for key, text in docs:
        for pos, line in enumerate(text.split("\n")):
            if words(line):
                norms.setdefault(" ".join(words(line)), []).append((key, pos))
    names = sorted(norms)
    u = Union()
    for n in names:
        u.find(n)
        for m in names:
            if n < m and distance(n, m) <= int((1 - similarity) * max(len(n), len(m)) + 1e-9):
                u.join(n, m)
    occurrences = {}
    for n in names:
        occurrences.setdefault(u.find(n), []).extend(norms[n])
    assert len(occurrences) < len(names)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = dict(map(tuple, df.select("doc_id", F.xxhash64("text")).collect()))
    drop = {o for own in occurrences.values() for o in own if o != min(own, key=lambda x: (x[0], hashes[x[0]], x[1]))}
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(df, similarity=similarity).collect()}
    dropped = 0
    for key, text in docs:
        lines = text.split("\n")
        left = got[key]["text"].split("\n") if got[key]["n_dropped"] < len(lines) else []
        gone = sorted(set(range(len(lines))) - {i for i, x in enumerate(lines) if (key, i) not in drop})
        assert got[key]["n_lines"] == len(lines) and got[key]["n_dropped"] <= len(gone)
        assert len(left) == len(lines) - got[key]["n_dropped"] and set(x for i, x in enumerate(lines) if i not in gone) <= set(left)
        dropped += got[key]["n_dropped"]
    assert dropped >= 0.98 * len(drop)


def test_simhash_bits(spark):
    random.seed(2)
    rows = [(n, h) for n in (1, 2, 3, 16, 17, 64, 126, 127) for h in [random.getrandbits(63) * random.choice([1, -1]) for _ in range(n)]]
    got = line_dedup.simhash(spark.createDataFrame(rows, "name int, h long"), ["name"], "h").collect()
    assert len(got) == 8
    for r in got:
        own = [h for n, h in rows if n == r["name"]]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in own) * 2 > len(own))
        assert r["n"] == len(own) and r["sim"] & ((1 << 64) - 1) == want


def test_line_dedup_in_buckets_of_common_blocks(spark):
    """Lines of one template that are no near copies: no link between them, and their near copies are found by other blocks."""
    random.seed(12)
    template = " ".join(f"boilerplate{i}" for i in range(24))
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    lines = [template + " " + " ".join(word() for _ in range(24)) for _ in range(300)]
    copies = [x[:-3] for x in lines[:40]]
    df = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.deduplicated(df, common=50).collect()}
    assert all(got[i] == 0 for i in range(300)) and sum(got[300 + i] for i in range(40)) >= 39


def lines_of_one_common_block(n, copies, seed=15):
    """Lines of 26 words that share the three words of one of eight blocks, and near copies that have another word in each other block."""
    random.seed(seed)
    block = lambda w: xxhash.xxh64_intdigest(w, seed=42) & 7
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8))

    def of(wanted, source=word):
        while block(w := source()) != wanted:
            pass
        return w

    common = [of(0) for _ in range(3)]
    bases = [common + [of(i % 7 + 1) for i in range(23)] for _ in range(n)]
    edited = lambda w: of(block(w), lambda: w[:-2] + random.choice("0123456789") + random.choice("0123456789"))
    return [" ".join(b) for b in bases], [" ".join(common + [edited(w) if i < 7 else w for i, w in enumerate(b[3:])]) for b in bases[-copies:]]


def test_line_dedup_compares_all_lines_of_a_common_block(spark):
    """The only block that a line and its copy agree in is one of a bucket of far more than `common` lines."""
    lines, copies = lines_of_one_common_block(160, 40)
    df = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.deduplicated(df, common=10).collect()}
    assert all(got[i] == 0 for i in range(160)) and all(got[160 + i] == 1 for i in range(40))


def test_pipeline_compares_all_lines_of_a_common_block(spark):
    """The stage with its own parameters."""
    import corpus_pipeline

    lines, copies = lines_of_one_common_block(1100, 20)
    df = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert all(left[i] == line for i, line in enumerate(lines)) and all(left[1100 + i] == "" for i in range(20))


@pytest.mark.parametrize("shared", [False, True])
def test_pipeline_compares_long_lines_of_one_block(spark, shared):
    """Lines of 48 words in sixteen blocks and near copies that have another word in each block but one, whose words all lines have, or line and copy alone."""
    import corpus_pipeline

    random.seed(16)
    block = lambda w: xxhash.xxh64_intdigest(w, seed=42) & 15
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8))

    def of(wanted, source=word):
        while block(w := source()) != wanted:
            pass
        return w

    common = [of(0) for _ in range(3)]
    bases = [(common if shared else [of(0) for _ in range(3)]) + [of(i % 15 + 1) for i in range(45)] for _ in range(30)]
    edited = lambda w: of(block(w), lambda: w[:-2] + "".join(random.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=2)))
    copies = [b[:3] + [next(e for e in iter(lambda w=w: edited(w), None) if e != w) if i < 15 else w for i, w in enumerate(b[3:])] for b in bases]
    df = spark.createDataFrame(list(enumerate(" ".join(b) for b in bases + copies)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert all(left[i] == " ".join(b) for i, b in enumerate(bases)) and all(left[30 + i] == "" for i in range(30))


def test_short_words_bring_no_unlike_lines_together(spark):
    """Lines that have the same twenty short words and no other in common share no block."""
    random.seed(18)
    short = [a + b for a in "abcde" for b in "lmno"]
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    lines = [" ".join(random.sample(short, 20) + [word() for _ in range(30)]) for _ in range(400)]
    docs = spark.createDataFrame([(i, i, line) for i, line in enumerate(lines)], "k long, t long, text string")
    keys = line_dedup._keyed(docs, 0.9).where("key is not null").select("key", "h1").distinct()
    assert keys.select("h1").distinct().count() == 400 and keys.groupBy("key").count().where("count > 1").count() == 0


def test_line_dedup_looks_at_lines_that_agree_in_two_long_words(spark):
    """Copies of lines of 47 words that have another word in each of sixteen blocks but one, which has two words."""
    random.seed(19)
    block = lambda w: xxhash.xxh64_intdigest(w, seed=42) & 15
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8))

    def of(wanted, source=word):
        while block(w := source()) != wanted:
            pass
        return w

    bases = [[of(0) for _ in range(2)] + [of(i % 15 + 1) for i in range(45)] for _ in range(30)]
    edited = lambda w: of(block(w), lambda: w[:-2] + "".join(random.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=2)))
    copies = [b[:2] + [next(e for e in iter(lambda w=w: edited(w), None) if e != w) if i < 15 else w for i, w in enumerate(b[2:])] for b in bases]
    shuffled = [random.sample(range(47), 47) for _ in bases]
    rows = [" ".join(own[i] for i in order) for side in (bases, copies) for own, order in zip(side, shuffled)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.deduplicated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] == 0 and got[30 + i] == 1 for i in range(30))


def test_line_dedup_leaves_the_session_as_it_was(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, during = spark.conf.get(name, None), []
    line_dedup._repeated, inner = lambda *a: during.append(spark.conf.get(name)) or inner(*a), line_dedup._repeated
    try:
        line_dedup.deduplicated(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"))
    finally:
        line_dedup._repeated = inner
    assert during == ["true"] and spark.conf.get(name, None) == before


def test_marks_agree_wherever_keys_do(spark):
    random.seed(9)
    lines = [random.sample(range(-(10**18), 10**18, 10**16), k=n) + list(range(i % 4)) for i, n in enumerate([1, 2, 5, 20, 40] * 6)]
    df = spark.createDataFrame([(i, k) for i, own in enumerate(lines) for k in own], "id int, key long").groupBy("id").agg(*line_dedup._marks("key"))
    a, b = (df.select(*[F.col(c).alias(f"{x}{c}") for c in ("id", *line_dedup.MARK_COLUMNS)]) for x in "ab")
    kept = {tuple(r)[:2] for r in a.crossJoin(b).where(line_dedup._marks_agree("a", "b", "2")).select("aid", "bid").collect()}
    want = {(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines) if len(set(x) & set(y)) >= 2}
    assert want <= kept and len(kept) < len(lines) ** 2


def test_line_dedup_is_the_same_however_buckets_are_dealt(spark):
    df = spark.createDataFrame(line_corpus(), "doc_id long, text string")
    kept = [sorted(map(tuple, line_dedup.deduplicated(df, common=n).collect())) for n in (1, 10**6)]
    assert kept[0] == kept[1]


def test_line_dedup_makes_no_table_of_unlike_pairs(spark, monkeypatch):
    """Lines of one common block meet where their texts are: pairs with a centre and links alone leave the tasks."""
    lines, copies = lines_of_one_common_block(160, 40, seed=20)
    df = spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")
    rows, inner = [], line_dedup._links
    monkeypatch.setattr(line_dedup, "_links", lambda pairs, *a: rows.append(pairs.count()) or inner(pairs, *a))
    assert line_dedup.deduplicated(df, common=10).where("n_dropped = 1").count() == 40
    assert sum(rows) < 4 * 200


def test_lines_near_a_few_of_a_group_meet_no_others(spark, monkeypatch):
    """A chain of lines, each near its neighbours only: those that are not near the centre join its group before all meet."""
    random.seed(26)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base, other = [word() for _ in range(60)], [word() for _ in range(60)]
    lines = [" ".join(other[:i] + base[i:-1] + [word()]) for i in range(18) for _ in range(8)]
    late, inner = [], line_dedup._late_links
    monkeypatch.setattr(line_dedup, "_late_links", lambda labelled, *a: late.append(labelled.where("label <> main").select("id").distinct().count()) or inner(labelled, *a))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.deduplicated(df).where("n_dropped = 1").count() == len(lines) - 1
    assert late[0] <= len(lines) // 10


def test_words_of_each_character(spark):
    rows = [(f"x{chr(c)}y{after}",) for c in range(1, 0x300) if chr(c) != "\n" for after in ("", "漢")]
    got = spark.createDataFrame(rows, "line string").select("line", F.lower("line").alias("low"), line_dedup.line_words(F.col("line")).alias("words"))
    assert all(r["words"] == regex.findall(r"[\p{L}\p{M}\p{N}]+", r["low"]) for r in got.collect())


def test_line_dedup_is_the_same_in_several_passes(spark, monkeypatch):
    df = spark.createDataFrame(line_corpus(), "doc_id long, text string")
    once = sorted(map(tuple, line_dedup.deduplicated(df).collect()))
    monkeypatch.setattr(line_dedup, "_passes", lambda *a: 3)
    assert sorted(map(tuple, line_dedup.deduplicated(df, common=5).collect())) == once


def test_beginnings_rule_out_no_near_line(spark):
    random.seed(21)
    rows = []
    for _ in range(1500):
        a = "".join(random.choices("abcd ", k=random.randrange(1, 120)))
        b = list(a)
        for _ in range(random.randrange(0, 14)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randrange(2)] = random.choice(["", "x", "a", "bc"])
        if random.random() < 0.2:
            b = b[7:] + b[:7]
        rows.append((a, "".join(b), random.randrange(0, 20)))
    got = spark.createDataFrame(rows, "a string, b string, edits int").selectExpr(f"{line_dedup._near('a', 'b', 'edits')} as near", "levenshtein(a, b) <= edits as want").collect()
    assert all(r["near"] == r["want"] for r in got) and 0 < sum(r["want"] for r in got) < len(rows)


def test_pieces_change_no_distance(spark):
    random.seed(23)
    rows = []
    words = lambda n: ["".join(random.choices("aeionst", k=random.randrange(1, 9))) for _ in range(n)]
    for n in [1, 7, 8, 60, 120, 200] * 50:
        a = words(n)
        b = list(a)
        for _ in range(random.randrange(0, 2 + n // 5)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randrange(3)] = words(random.randrange(3))
        if random.random() < 0.3:
            b = [*b[n // 3 :], *words(random.randrange(40))]
        rows.append((" ".join(a), " ".join(b), random.choice([0, 3, n // 4, n // 2])))
    rows += [("x" * 5000 + " " + a, b, 600) for a, b, _ in rows[5::60]] + [(a, "", 5) for a, _, _ in rows[:9]]
    split = "struct(split(a, ' ') as xw, split(b, ' ') as yw)"
    df = spark.createDataFrame(rows, "a string, b string, edits int")
    pieces = line_dedup._let(split, "w", line_dedup._pieces_near("edits"))
    got = df.selectExpr(f"{line_dedup._near('a', 'b', 'edits')} as near", f"{pieces} as pieces", "levenshtein(a, b) <= edits as want").collect()
    assert all(r["near"] == r["want"] for r in got) and 50 < sum(r["want"] for r in got) < len(rows) - 50
    assert all(r["want"] for r in got if r["pieces"]) and sum(r["pieces"] for r in got) > 0.8 * sum(r["want"] for r in got)


def test_near_long_lines_take_no_square_of_their_length(spark):
    random.seed(24)
    a = ["".join(random.choices("aeionst", k=random.randrange(2, 9))) for _ in range(12_000)]
    b = list(a)
    for _ in range(200):
        at = random.randrange(len(b))
        b[at : at + random.randrange(2)] = ["edited"]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), 6000)], "a string, b string, edits int").selectExpr(f"{line_dedup._near('a', 'b', 'edits')} as near")
    started = time.monotonic()
    assert df.first()["near"] and time.monotonic() - started < 10


def test_letters_rule_out_no_near_line(spark):
    random.seed(8)
    rows = []
    for n in [1, 5, 40, 300, 30_000] * 12:
        a = random.choices("ek" if n == 30_000 else "etaoin shrdlukwxyzñ漢🙂", k=n)
        b, edits = list(a), random.randint(0, 12)
        for _ in range(edits):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randint(0, 1)] = random.choice(["", "t", "k", " ", "z"])
        rows.append(("".join(a), "".join(b), edits))
    df = spark.createDataFrame(rows, "a string, b string, edits int")
    sides = [regex.sub(r" as (l\d*)$", rf" as {x}\1", e) for x in "ab" for e in line_dedup._letters(x)]
    near = df.selectExpr("*", *sides).selectExpr("*", f"{line_dedup._letters_near('a', 'b', 'edits')} as near").collect()
    lanes = lambda t: Counter({c: min(t.count(c), line_dedup.MOST_COUNTED) for c in line_dedup.LETTERS})
    over = lambda x, y: sum((lanes(x) - lanes(y)).values())
    assert all(r["near"] for r in near)
    tight = df.selectExpr("a", "reverse(upper(a)) || b as b", "edits").selectExpr("*", *sides).selectExpr("*", f"{line_dedup._letters_near('a', 'b', 'edits')} as near").collect()
    assert all(r["near"] == (max(over(r["a"], r["b"]), over(r["b"], r["a"])) <= r["edits"]) for r in [*near, *tight])


def test_line_dedup_keeps_columns_with_its_own_names(spark):
    rows = [(1, "one two three", 7, 8, 9, 10), (2, "one two three", 7, 8, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, word int, drop_k int, __k int")
    got = line_dedup.deduplicated(df)
    assert got.columns == [*df.columns, "_n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, "one two three", 7, 8, 9, 10, 1, 0), (2, "", 7, 8, 9, 10, 1, 1)]


def test_line_dedup_edges(spark, messy, nothing):
    got = line_dedup.deduplicated(messy)
    rows = got.collect()
    assert len(rows) == 12 and set(got.columns) == {*messy.columns, "n_lines", "n_dropped"}
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["text"].startswith("The quick") and by_id[6]["text"] == "" and by_id[3]["text"] is None and by_id[3]["n_lines"] == 0
    assert [r["text"] for r in rows if r["doc_id"] == 5] == ["x", "x"]
    assert line_dedup.deduplicated(nothing).count() == 0


def test_line_dedup_runs_no_python(spark, messy, monkeypatch):
    """Neither in the last plan nor in that of any table on the way."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for module in (line_dedup, components):
        written = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, written=written: plans.append(plan(df)) or written(df, name))
    plans.append(plan(line_dedup.deduplicated(messy)))
    assert len(plans) > 10 and not any(x in p for p in plans for x in ("Python", "MapIn"))


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(40):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 30))):
            out.append((centre + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.35])).astype(np.float32).tolist())
    return out


def test_forest_finds_links(spark):
    data = vectors()
    x = np.array(data)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    u = Union()
    for i in range(len(data)):
        u.find(i)
        for j in np.flatnonzero(near[i]):
            u.join(i, int(j))
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in rp_forest.near_duplicate_vectors(df, leaf=60, leaf_most=50, trees=16).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert found >= 0.99 * near.sum()
    assert sum(got[i]["component_id"] != u.find(i) for i in got) <= 0.01 * len(got)
    whole = {r["vec_id"]: r for r in rp_forest.near_duplicate_vectors(df, leaf=10**6, leaf_most=10**6, trees=2).collect()}
    assert all(whole[i]["n_links"] == near[i].sum() and whole[i]["component_id"] == u.find(i) for i in whole)


def test_forest_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1e30, 1e-30])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, leaf string")
    got = rp_forest.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by_id[2] == (4, 1, False) and by_id[1] == (4, 1, True) and by_id[12] == (4, 1, False)
    assert by_id[None] == (0, None, True) and all(by_id[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert rp_forest.near_duplicate_vectors(df.limit(0)).count() == 0


def bit_distance(a, b):
    """Edit distance by the bits of one integer (Myers)."""
    places, top, mask = {}, 1 << (len(a) - 1), (1 << len(a)) - 1
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, out = mask, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        x, y = eq | down, (((eq & up) + up) ^ up) | eq
        h, l = down | ~(y | up), up & y
        out += bool(h & top) - bool(l & top)
        h, l = h << 1 | 1, l << 1
        up, down = (l | ~(x | h)) & mask, h & x & mask
    return out


def test_line_dedup_finds_near_lines_by_edit_similarity_alone(spark):
    """Recall with the parameters in use; what a near line is depends on no hash."""
    random.seed(4)
    vocabulary = ["".join(random.choices("abcdefghijklmnoprstuvw", k=random.randint(2, 9))) for _ in range(800)]
    lines = []
    for n in [1, 2, 3] * 5 + [8, 12, 20, 50] * 30:
        base = random.choices(vocabulary, k=n) if n > 3 else [w * 3 for w in random.choices(vocabulary, k=n)]
        lines.append(" ".join(base))
        for edits in (1, random.choice([1, 2, 3]) if n > 12 else 1):
            own = list(base)
            for _ in range(edits):
                i = random.randrange(n)
                j = random.randrange(len(own[i]))
                own[i] = own[i][:j] + "z" + own[i][j + random.randint(0, 1) :]
            lines.append(" ".join(own))
        if n > 12:
            own = list(base)
            own[random.randrange(n)] = random.choice(vocabulary)
            lines.append(" ".join(own))
    random.shuffle(lines)
    lines = list(dict.fromkeys(lines))
    u = Union()
    for i, a in enumerate(lines):
        u.find(i)
        for j in range(i):
            b = lines[j]
            most = int(max(len(a), len(b)) * 0.1 + 1e-9)
            if abs(len(a) - len(b)) <= most and bit_distance(a, b) <= most:
                u.join(i, j)
    near = sum(u.find(i) != i for i in range(len(lines)))
    assert near > 200
    got = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_dropped > 0").select("doc_id").collect()
    assert all(u.find(r["doc_id"]) != r["doc_id"] for r in got)
    assert len(got) >= 0.98 * near


def test_forest_keeps_all_links_of_a_dense_group(spark):
    """Different near copies of one vector, more than a leaf holds, among others; some rows lie at the group's edge."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    noise = np.concatenate([np.full(10_000, 0.15), rng.uniform(0.3, 0.7, 1000)])
    data = np.concatenate([centre + rng.standard_normal((11_000, 64)) * noise[:, None], rng.standard_normal((4000, 64))]).astype(np.float32)
    data = data[rng.permutation(len(data))]
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    want = np.concatenate([(unit[i : i + 1000] @ unit.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(unit), 1000)])
    df = spark.createDataFrame(list(enumerate(data.tolist())), "vec_id long, embedding array<float>")
    got = np.zeros(len(data), np.int64)
    rows = rp_forest.near_duplicate_vectors(df).collect()
    for r in rows:
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all() and got.sum() >= 0.9999 * want.sum()
    assert (got[want >= 9000] == want[want >= 9000]).all()
    assert len({r["component_id"] for r in rows if want[r["vec_id"]]}) == 1


def test_minhash_rows_follow_the_threshold(spark, monkeypatch):
    used = {}
    original = minhash_dedup.sketches
    monkeypatch.setattr(minhash_dedup, "sketches", lambda docs, size, bands, rows: used.update({size: (bands, rows)}) or original(docs, size, bands, rows))
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    for size, percent in ((5, 80), (3, 85)):
        minhash_dedup.near_duplicates(docs, size=size, percent=percent)
        bands, rows = used[size]
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6
