import random
import re

from oracle import connect, difference
from pyspark.sql import functions as F

from tallyspan.llm import oracles, overlap
from tallyspan.llm.queries import QUERIES
from tallyspan.session import materialise, table

QA = "example_id long, benchmark_file string, question string, file string, plain string"
MANIFESTS = "benchmark_file string, development_benchmark string, purpose string, freeze_status string"


def facts(plain, places):
    """The facts of a question, word by word; ``places`` has names by first word, longest first."""
    words, named, i = plain.split(), [], 0
    while i < len(words):
        hit = next((p for p in places.get(words[i], ()) if " ".join(words[i : i + p.count(" ") + 1]) == p), None)
        named += [hit] if hit else []
        i += hit.count(" ") + 1 if hit else 1
    ages = set()
    for i, w in enumerate(words[:-1]):
        if w in ("aged", "age", "ages") and re.fullmatch(r"\d{1,3}", words[i + 1]):
            rest = [x for x in words[i + 2 : i + 5] if x not in ("to", "and", "years", "year")]
            end = rest[0] if rest and re.fullmatch(r"\d{1,3}|over|older|up", rest[0]) else ""
            ages.add(f"{int(words[i + 1])}-{'' if not end else int(end) if end.isdigit() else 'over'}")
    of = lambda kind, found: [f"{kind} {x}" for x in sorted(set(found))]
    years = [w for w in words if re.fullmatch(r"(?:19|20)\d\d", w)]
    meant = lambda table: [table[w] for w in words if w in table]
    return [*of("place", named), *of("year", years), *of("ages", ages), *of("sex", meant(overlap.SEXES)), *of("group", meant(overlap.GROUPS))]


def names_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_pairs_match_brute_force(spark, small):
    rows = table(spark, small, "qa_examples").where("question is not null").collect()
    manifests = table(spark, small, "freeze_manifests").collect()
    plain_path = lambda p: re.sub(r"^\./", "", p.strip().lower().replace("\\", "/"))
    evaluation = {plain_path(m.benchmark_file) for m in manifests if m.freeze_status == "frozen"}
    training = {plain_path(m.development_benchmark) for m in manifests if m.development_benchmark}
    census = table(spark, small, "census_rows")
    names = [r.name for r in overlap.place_names((census, "planning_area"), (census, "number_label")).collect()]
    by_first = {}
    for n in sorted(names, key=lambda n: -len(n)):
        by_first.setdefault(n.split()[0], []).append(n)
    sides = {s: [(r.example_id, overlap.plain_words(r.question)) for r in rows if plain_path(r.benchmark_file) in files] for s, files in (("e", evaluation), ("t", training))}
    want = set()
    for i, a in sides["e"]:
        for j, b in sides["t"]:
            short, other = sorted((a.split(), b.split()), key=len)
            if 4 * sum(w in other for w in short) >= 3 * len(short) and facts(a, by_first) == facts(b, by_first):
                want.add((min(i, j), max(i, j)))
    assert {tuple(r) for r in QUERIES["p4_found"](spark, small).collect()} == want


def test_spelling_copies_and_roles(spark):
    q = "How many male residents aged 25 to 34 lived in Astley Moor in 1981 by the table?"
    rows = [
        (1, "./E.jsonl", q),
        (2, "t.jsonl", q.upper()),
        (3, "t.jsonl", "Q 7: how mány male residents aged 25 to 34 lived in Ａｓｔｌｅｙ Mo​or in 1981 by the tabel?"),
        (4, "t.jsonl", q.replace("male", "female")),
        (5, "t.jsonl", q.replace("1981", "1982")),
        (6, "t.jsonl", "Male residents aged 25 to 34: say something wholly other about Astley Moor in 1981, please, now."),
        (7, "other.jsonl", q),
        (8, "T.JSONL ", None),
        (9, "t.jsonl", q),
        (10, "e.jsonl", q),
        (11, "t.jsonl", ""),
        (12, None, q),
    ]
    examples = spark.createDataFrame([(*r, "clash", "clash") for r in rows], QA)
    manifests = spark.createDataFrame([("e.jsonl", ".\\t.jsonl".replace(".\\", "./"), "final", "frozen"), ("other.jsonl", None, None, "open"), (None, None, "draft", None)], MANIFESTS)
    names = names_of(spark, "astley moor", "astley")
    pairs = overlap.overlaps(examples, manifests, names)
    assert sorted((r.evaluation_id, r.training_id) for r in pairs.collect()) == [(e, t) for e in (1, 10) for t in (2, 3, 9)]
    report = overlap.overlap_report(examples, manifests, names).collect()
    assert [(r.evaluation_file, r.purpose, r.training_file, r.n_pairs, r.n_evaluation, r.n_training) for r in report] == [("e.jsonl", "final", "t.jsonl", 6, 2, 3)]
    assert overlap.overlaps(examples.limit(0), manifests, names).count() == 0 and overlap.overlaps(examples, manifests.limit(0), names.limit(0)).count() == 0
    assert overlap.overlap_report(examples, manifests.limit(0), names).count() == 0


def test_report_counts_the_pairs(spark):
    """A file in both splits, copies, and a file that only copies itself."""
    q = "How many male residents aged 25 to 34 lived in Astley Moor in 1981 by the table?"
    rows = [(1, "a", q), (2, "a", q), (3, "b", q.replace("many", "few")), (4, "b", q), (5, "c", q.replace("1981", "1999")), (6, "c", q.replace("1981", "1977"))]
    examples = spark.createDataFrame([(*r, "", "") for r in rows], QA)
    manifests = spark.createDataFrame([(f, t, "final", "frozen") for f, t in (("a", "a"), ("c", "b"), ("b", "c"), ("a", None))], MANIFESTS)
    names = names_of(spark, "astley moor")
    pairs = overlap.overlaps(examples, manifests, names).collect()
    want = {}
    for r in pairs:
        e, t, n = want.setdefault((r.evaluation_file, r.training_file), (set(), set(), []))
        e.add(r.evaluation_id), t.add(r.training_id), n.append(1)
    got = {(r.evaluation_file, r.training_file): (r.n_pairs, r.n_evaluation, r.n_training) for r in overlap.overlap_report(examples, manifests, names).collect()}
    assert got == {k: (len(n), len(e), len(t)) for k, (e, t, n) in want.items()} and got["a", "a"] == (2, 2, 2) and ("c", "c") not in got


def test_recall_of_altered_questions_and_hot_codes(spark):
    """Words changed, left out and put in up to the limit: all pairs are found, on words too."""
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("lor", "men", "tar", "vos", "quil", "bre") for b in ("dan", "ix", "ume", "pel", "oth", "ran", "sk")]
    rows, want = [], set()
    for i in range(150):
        fact = [f"{rng.choice(['male', 'female'])} residents aged {rng.randrange(10, 30)} to {rng.randrange(40, 60)} in astley moor in {rng.randrange(1950, 2020)}"]
        words = rng.sample(vocabulary, rng.randrange(6, 12))
        n = len(words) + len(fact[0].split())
        other = list(words)
        for j in rng.sample(range(len(words)), rng.randrange(0, min(len(words), n // 4) + 1)):
            other[j] = rng.choice(["", "zzz", "zzz yyy xxx"])
        rows += [(2 * i, "e", " ".join(words + fact)), (2 * i + 1, "t", " ".join(fact + other))]
    split = lambda r: r[2].split()
    sides = {s: [(r[0], facts(" ".join(split(r)), {"astley": ["astley moor"]}), split(r)) for r in rows if r[1] == s] for s in "et"}
    for i, f, a in sides["e"]:
        for j, g, b in sides["t"]:
            short, other = sorted((a, b), key=len)
            if f == g and 4 * sum(w in other for w in short) >= 3 * len(short):
                want.add((i, j))
    texts = spark.createDataFrame([(str(i), " ".join(t.split()), r == "e", r == "t") for i, r, t in rows], "qid string, plain string, in_evaluation boolean, in_training boolean")
    named = overlap.with_facts(texts, names_of(spark, "astley moor"))
    hashes = F.transform(overlap.other_words(named.plain, named.facts), lambda w: F.xxhash64(w))
    coded = materialise(named.withColumn("code", overlap.fingerprint(overlap.features(named.facts), hashes)))
    for hot in (0, 10**9):
        assert {(int(r.qid_a), int(r.qid_b)) for r in overlap.similar_questions(coded, hot).collect()} == want
    assert len(want) >= 150
    codes = coded.groupBy("code").agg(F.count_if("in_evaluation").alias("n_evaluation"), F.count_if("in_training").alias("n_training"))
    assert overlap.near_codes(codes).count() < 400  # other facts lie far apart


def test_near_codes_share_a_key(spark):
    rng = random.Random(1)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(200)]
    near = []
    for c in codes:
        flip = c & ((1 << 64) - 1)
        for b in rng.sample(range(64), rng.randrange(overlap.RADIUS + 1)):
            flip ^= 1 << b
        near.append((c, flip - (1 << 64) if flip >> 63 else flip))
    df = spark.createDataFrame(near, "a long, b long")
    assert df.select(overlap.block_keys(df.a).alias("a"), overlap.block_keys(df.b).alias("b")).where("not arrays_overlap(a, b)").count() == 0


def test_pairs_without_facts_and_beyond_the_radius_match_sql(spark, tmp_path):
    """Questions that name nothing, blank ones, and two of the same facts whose codes lie 4 bits apart."""
    near = "this male residents aged 19 to 78 in 2012"
    far = "male residents aged 19 to 78 in 2012 and what earlier be this given that rows compares the published to this"
    rows = [(1, "e", near), (2, "t", far), (3, "e", "Which of the tables is the largest?"), (4, "t", "which of the tables is largest"), (5, "t", "which of the tables is largest in 2012"), (6, "e", " ?"), (7, "t", ""), (8, "t", "of"), (9, "e", "of"), (10, "e", None)]
    spark.createDataFrame(rows, "example_id long, benchmark_file string, question string").write.parquet(f"{tmp_path}/qa_examples.parquet")
    spark.createDataFrame([("e", "t", "final", "frozen")], MANIFESTS).write.parquet(f"{tmp_path}/freeze_manifests.parquet")
    spark.createDataFrame([("Astley Moor", "Astley Moor - Total")], "planning_area string, number_label string").write.parquet(f"{tmp_path}/census_rows.parquet")
    spark.createDataFrame([("North",)], "planning_region string").write.parquet(f"{tmp_path}/region_rows.parquet")
    got = {tuple(r) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (3, 4), (6, 7), (3, 8), (4, 9), (8, 9)}
    for name in ("p4_found", "p4_report"):
        assert difference(QUERIES[name](spark, str(tmp_path)), oracles.ORACLES[name], connect(str(tmp_path))) == ""


def test_hot_facts_with_repeated_words(spark):
    """Of two texts of equal length either may be the one whose words the other has."""
    texts = spark.createDataFrame([("1", "x x x z", True, False), ("2", "x p q r", False, True), ("3", "p q z r", True, True)], "qid string, plain string, in_evaluation boolean, in_training boolean")
    coded = materialise(texts.withColumn("facts", F.array().cast("array<string>")).withColumn("code", F.xxhash64("qid")))
    for hot in (0, 10**9):
        assert sorted(map(tuple, overlap.similar_questions(coded, hot).collect())) == [("1", "2"), ("3", "2"), ("3", "3")]
