"""Same or nearly same questions across evaluation and training files.

A question names facts: place, years, ages, sex and population group.  Its
fingerprint is a 64-bit similarity hash of these facts and, at a lower weight,
of its other words.  Distinct fingerprints are joined across the splits on
permuted pairs of their five blocks (two of five blocks agree in any pair within
Hamming distance 3), and the texts of each pair of fingerprints are verified: the
same facts, and at least three quarters of the words of the shorter question in
the other.  The pair definition bounds no distance between the words (the longer
question may hold any number more), so their weight is one at which they change
few bits, and texts of the same facts whose fingerprints lie further apart are
compared as well: no pair depends on the radius.

Equal texts are grouped before the join and expanded after it, so that copies
cost one comparison; texts whose facts very many different texts share are
joined on words, of which each match must share a rare one.  Defined cases: null
questions, null files and files of neither split take no part; an example whose
file is in both splits is compared in both roles, never with itself; questions
that name no fact name the same facts, and those without a word the same words;
empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyspan.operators.names import named_spans
from tallyspan.session import look_up, materialise

BLOCKS, RADIUS = 5, 3
_BOUNDS = (0, 13, 26, 39, 52, 64)
KINDS = ("place", "year", "ages", "sex", "group")
#: Weight of all other words together against each feature of the facts.  On
#: check_l all 2,524 pairs of different questions that brute force finds lie
#: within distance 3 (2,272, 227 and 25 pairs at 0, 1 and 2), so a radius of 0
#: would lose a tenth of them; at higher weights some pairs lie beyond 3.
WORD_WEIGHT = 0.4
#: Pairs of texts of the same facts that are compared without words.
HOT_PAIRS = 100_000

# Words that name a sex or a population group.
SEXES = {"male": "male", "males": "male", "men": "male", "female": "female", "females": "female", "women": "female"}
GROUPS = {"resident": "resident", "residents": "resident", "citizen": "citizen", "citizens": "citizen", "visitor": "visitor", "visitors": "visitor"}
_AGES = r"\b(?:aged|ages|age) ([0-9]{1,3})(?= |\z)(?: (?:to|and|years|year)){0,2}(?: ([0-9]{1,3}|over|older|up)(?= |\z))?"
_ASCII = {b: chr(b).lower() if chr(b).isalnum() else " " for b in range(128)}


def plain_words(text: str) -> str:
    """Words in lower case without accents, width, invisible signs, punctuation."""
    if text.isascii():
        return " ".join(text.translate(_ASCII).split())
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return " ".join(re.findall(r"[^\W_]+", text))


@F.pandas_udf(T.StringType())
def _plain_words(texts: pd.Series) -> pd.Series:
    return texts.map(plain_words, na_action="ignore")


def path(raw: Column) -> Column:
    """A file path in its plain spelling."""
    return F.regexp_replace(F.replace(F.lower(F.trim(raw)), F.lit("\\"), F.lit("/")), r"^\./", "")


def splits(manifests: DataFrame) -> DataFrame:
    """(file, role, purpose): evaluation files of frozen manifests, and training
    files."""
    frozen = F.lower(F.trim("freeze_status")) == "frozen"
    evaluation = manifests.where(frozen & F.col("benchmark_file").isNotNull()).select(path(F.col("benchmark_file")).alias("file"), F.lit("evaluation").alias("role"), "purpose")
    training = manifests.where("development_benchmark is not null").select(path(F.col("development_benchmark")).alias("file"), F.lit("training").alias("role"), F.lit(None).cast("string").alias("purpose"))
    return evaluation.unionByName(training).distinct()


def place_names(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(name): distinct place names in plain words; national and total labels left out."""
    names = None
    for df, column in columns:
        part = df.select(F.col(column).alias("name")).where("name is not null").distinct()
        names = part if names is None else names.unionByName(part)
    plain = F.regexp_replace(_plain_words("name"), r"\s+total\z", "")
    return names.select(plain.alias("name")).where("name not in ('', 'total')").distinct()


def with_facts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``facts`` to (qid, plain): what a question names, in a fixed order."""
    words = F.split("plain", " ")
    several = lambda found: F.array_sort(F.array_distinct(found))
    told = lambda kind, found: F.transform(several(found), lambda x: F.concat(F.lit(f"{kind} "), x))

    def meant(table: dict[str, str]) -> Column:
        meaning = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
        return F.filter(F.transform(words, lambda w: meaning[w]), lambda x: x.isNotNull())

    def ages(m: Column) -> Column:
        end = F.regexp_extract(m, _AGES, 2)
        whole = lambda digits: digits.try_cast("int").cast("string")
        return F.concat(whole(F.regexp_extract(m, _AGES, 1)), F.lit("-"), F.when(end == "", "").otherwise(F.coalesce(whole(end), F.lit("over"))))

    places = named_spans(texts, "qid", "plain", names).groupBy("qid").agg(F.collect_set("name").alias("_places"))
    rows = texts.join(places, "qid", "left")
    facts = F.concat(
        told("place", F.coalesce("_places", F.array().cast("array<string>"))),
        told("year", F.filter(words, lambda w: w.rlike(r"^(?:19|20)[0-9]{2}\z"))),
        told("ages", F.transform(F.regexp_extract_all("plain", F.lit(_AGES), F.lit(0)), ages)),
        told("sex", meant(SEXES)),
        told("group", meant(GROUPS)),
    )
    return rows.withColumn("facts", facts).drop("_places")


def features(facts: Column) -> Column:
    """What a fingerprint has of the facts: each three of the five kinds, and all.

    Single facts would not do: questions share many of them, and their hashes
    would agree in whole blocks.  Two questions that differ in one kind share 4
    of the 11 features, those that differ in two kinds share 1.
    """
    def of(kind: str) -> Column:
        return F.array_join(F.filter(facts, lambda f: f.startswith(f"{kind} ")), "|")

    kinds = [of(kind) for kind in KINDS]
    threes = [F.xxhash64(F.lit("".join(map(str, three))), *(kinds[i] for i in three)) for three in combinations(range(len(KINDS)), 3)]
    return F.array(*threes, F.xxhash64(F.array_join(facts, "&")))


def other_words(plain: Column, facts: Column) -> Column:
    """The distinct words of a question that are no words of its facts."""
    return F.array_except(F.split(plain, " "), F.split(F.array_join(facts, " "), " "))


@F.pandas_udf(T.LongType())
def fingerprint(facts: pd.Series, words: pd.Series) -> pd.Series:
    """64-bit similarity hash: each bit is the weighted majority over the hashes."""
    codes = []
    for at in range(0, len(facts), 1000):
        sums = 0.0
        for hashes, weight in ((facts[at : at + 1000], None), (words[at : at + 1000], WORD_WEIGHT)):
            sizes = hashes.map(len).to_numpy()
            flat = np.concatenate([*hashes, np.zeros(1, dtype=np.int64)]).astype(np.int64)
            signs = 2.0 * np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1) - 1
            upto = np.concatenate([np.zeros((1, 64)), signs.cumsum(axis=0)])
            ends = np.cumsum(sizes)
            part = upto[ends] - upto[ends - sizes]
            sums = sums + (part if weight is None else part * (weight / np.sqrt(np.maximum(sizes, 1)))[:, None])
        codes.append(np.packbits(sums > 0, axis=1).view(np.int64)[:, 0])
    return pd.Series(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64))


def coded_questions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct plain texts with their facts (none, for some), code and splits.

    ``rows`` has qid, plain and role; result: qid, plain, in_evaluation,
    in_training, facts, code.
    """
    has = lambda role: F.max(F.col("role") == role)
    distinct = materialise(rows.groupBy("qid").agg(F.first("plain").alias("plain"), has("evaluation").alias("in_evaluation"), has("training").alias("in_training")))
    named = with_facts(distinct, names)
    hashes = F.transform(other_words(F.col("plain"), F.col("facts")), lambda w: F.xxhash64(w))
    return named.withColumn("code", fingerprint(features(F.col("facts")), hashes))


def _block(code: Column, b: int) -> Column:
    size = _BOUNDS[b + 1] - _BOUNDS[b]
    return F.shiftrightunsigned(code, _BOUNDS[b]).bitwiseAND(F.lit((1 << size) - 1))


def block_keys(code: Column) -> Column:
    """The permuted keys of a code: for each choice of blocks, its number and bits."""
    return F.array(*(F.struct(F.lit(n).alias("permutation"), F.shiftleft(_block(code, a), 13).bitwiseOR(_block(code, b)).alias("bits")) for n, (a, b) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))))


def _first_permutation(apart: Column) -> Column:
    """The first choice of blocks in which two codes agree, from their bits apart."""
    chosen = None
    for n, (a, b) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        agree = (_block(apart, a) == 0) & (_block(apart, b) == 0)
        chosen = F.when(agree, n) if chosen is None else chosen.when(agree, n)
    return chosen


def near_codes(codes: DataFrame) -> DataFrame:
    """(code_a, code_b): codes across the splits within RADIUS, each pair once.

    ``codes`` has code, n_evaluation, n_training."""

    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("code").alias(f"code_{side}"), F.explode(block_keys(F.col("code"))).alias("key")).select(f"code_{side}", "key.permutation", "key.bits")

    # Sizes are known before the keys are exploded, so the planner would broadcast too much.
    near = keyed(codes.where("n_evaluation > 0"), "a").hint("merge").join(keyed(codes.where("n_training > 0"), "b"), ["permutation", "bits"])
    apart = F.col("code_a").bitwiseXOR(F.col("code_b"))
    return near.where((F.bit_count(apart) <= RADIUS) & (_first_permutation(apart) == F.col("permutation"))).select("code_a", "code_b")


def _side(coded: DataFrame, s: str) -> DataFrame:
    """The questions of one split, evaluation (a) or training (b)."""
    return coded.where("in_evaluation" if s == "a" else "in_training").select("facts", *(F.col(c).alias(f"{c}_{s}") for c in ("qid", "code", "plain")))


def _alike() -> Column:
    """At least three quarters of the words of the shorter text are in the other."""
    a, b = F.split("plain_a", " "), F.split("plain_b", " ")
    within = lambda x, y: F.size(F.filter(x, lambda w: F.array_contains(y, w))) * 4 >= F.size(x) * 3
    return ((F.size(a) <= F.size(b)) & within(a, b)) | ((F.size(b) <= F.size(a)) & within(b, a))


def _sharing_words(coded: DataFrame) -> DataFrame:
    """(qid_a, qid_b) of the matches among questions whose facts very many share.

    Of any quarter and one more of the shorter text's words the other has one, so
    each text looks for partners by those that are rarest beside its facts.
    """
    words = coded.select("qid", "facts", F.explode(F.split("plain", " ")).alias("word"))
    counts = materialise(words.groupBy("facts", "word").agg(F.count("*").alias("n")))
    ranked = look_up(words, counts, ["facts", "word"], "inner").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    rare = F.slice(F.col("ranked.word"), 1, F.floor(F.size("ranked") / 4).cast("int") + 1)
    texts = materialise(coded.join(ranked.select("qid", F.array_distinct(rare).alias("rare")), "qid"))
    found = None
    for short, other in ("ab", "ba"):
        few = _side(texts, short).join(texts.select(F.col("qid").alias(f"qid_{short}"), "rare"), f"qid_{short}").withColumn("word", F.explode("rare")).drop("rare")
        all_ = _side(texts, other).withColumn("word", F.explode(F.array_distinct(F.split(f"plain_{other}", " "))))
        pairs = few.hint("merge").join(all_, ["facts", "word"]).where(_alike()).select("qid_a", "qid_b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def similar_questions(coded: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(qid_a, qid_b) of questions that match across the splits, each pair once.

    ``coded`` is of :func:`coded_questions`.  Only codes go through the join on
    the blocks; texts are looked up for the candidates.  No bound on the codes
    follows from the pair definition, so questions of the same facts whose codes
    lie beyond RADIUS are compared as well.
    """
    groups = coded.groupBy("facts").agg(F.count_if("in_evaluation").alias("n_a"), F.count_if("in_training").alias("n_b"), (F.min("code") < F.max("code")).alias("several"))
    groups = materialise(groups.where("n_a > 0 and n_b > 0").select("facts", "several", (F.col("n_a") * F.col("n_b") > hot_pairs).alias("hot")))
    hot = materialise(groups.where("hot").select("facts"))
    some_hot = hot.limit(1).count() > 0
    cold = materialise(look_up(coded, hot, ["facts"], "left_anti")) if some_hot else coded
    codes = cold.groupBy("code").agg(F.count_if("in_evaluation").alias("n_evaluation"), F.count_if("in_training").alias("n_training"))
    near = materialise(near_codes(materialise(codes)))
    first, second = _side(cold, "a"), _side(cold, "b")
    within = first.join(near, "code_a").join(second, ["code_b", "facts"])
    several = materialise(groups.where("several and not hot").select("facts"))
    beyond = look_up(first, several, ["facts"], "left_semi").join(look_up(second, several, ["facts"], "left_semi"), "facts").where(F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) > RADIUS)
    found = within.unionByName(beyond).where(_alike()).select("qid_a", "qid_b")
    return found.unionByName(_sharing_words(materialise(look_up(coded, hot, ["facts"], "left_semi")))) if some_hot else found


def _matched(examples: DataFrame, manifests: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched pairs of questions, evaluation members, training members).

    Members (qid, example_id, file) are those of questions in some pair.
    """
    roles = splits(manifests).select("file", "role").distinct()
    rows = examples.where("question is not null").select(F.col("example_id").cast("long").alias("example_id"), path(F.col("benchmark_file")).alias("file"), _plain_words("question").alias("plain"))
    # The manifests name a bounded number of files.
    rows = rows.join(F.broadcast(roles), "file").withColumn("qid", F.md5("plain"))
    rows = materialise(rows)
    matched = materialise(similar_questions(materialise(coded_questions(rows, names))))

    def members(role: str, side: str) -> DataFrame:
        wanted = materialise(matched.select(F.col(side).alias("qid")).distinct())
        return materialise(look_up(rows.where(F.col("role") == role).select("qid", "example_id", "file"), wanted, ["qid"], "inner"))

    return matched, members("evaluation", "qid_a"), members("training", "qid_b")


def overlaps(examples: DataFrame, manifests: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of an evaluation and a training example that match.

    ``names`` has the plain place names.  Result: evaluation_id,
    evaluation_file, training_id, training_file.
    """
    matched, evaluation, training = _matched(examples, manifests, names)
    pairs = look_up(evaluation.select(F.col("qid").alias("qid_a"), F.col("example_id").alias("evaluation_id"), F.col("file").alias("evaluation_file")), matched, ["qid_a"], "inner")
    pairs = look_up(pairs, training.select(F.col("qid").alias("qid_b"), F.col("example_id").alias("training_id"), F.col("file").alias("training_file")), ["qid_b"], "inner")
    return pairs.where("evaluation_id <> training_id").select("evaluation_id", "evaluation_file", "training_id", "training_file")


def overlap_report(examples: DataFrame, manifests: DataFrame, names: DataFrame) -> DataFrame:
    """Counts per evaluation file and purpose, and training file (the source).

    Result: evaluation_file, purpose, training_file, n_pairs, n_evaluation and
    n_training (examples in some pair).  They come from the numbers of members of
    each question by file; no pair of examples is formed.
    """
    matched, evaluation, training = _matched(examples, manifests, names)
    a = evaluation.groupBy(F.col("qid").alias("qid_a"), F.col("file").alias("evaluation_file")).agg(F.count("*").alias("n_a"))
    b = training.groupBy(F.col("qid").alias("qid_b"), F.col("file").alias("training_file")).agg(F.count("*").alias("n_b"))
    cells = materialise(matched.join(a, "qid_a").join(b, "qid_b"))
    # An example is no partner of itself where one file is in both splits.
    own = ((F.col("qid_a") == F.col("qid_b")) & (F.col("evaluation_file") == F.col("training_file"))).cast("long")
    files = ["evaluation_file", "training_file"]
    total = cells.groupBy(files).agg(F.sum(F.col("n_a") * F.col("n_b") - own * F.col("n_a")).alias("n_pairs"))

    def with_partner(side: str, other: str, name: str) -> DataFrame:
        each = cells.groupBy(*files, f"qid_{side}", f"n_{side}").agg((F.sum(f"n_{other}") - F.max(own)).alias("partners")).where("partners > 0")
        return each.groupBy(files).agg(F.sum(f"n_{side}").alias(name))

    counts = total.join(with_partner("a", "b", "n_evaluation"), files).join(with_partner("b", "a", "n_training"), files)
    purposes = splits(manifests).where("role = 'evaluation'").select(F.col("file").alias("evaluation_file"), "purpose")
    # The manifests name a bounded number of files.
    return counts.join(F.broadcast(purposes), "evaluation_file").select("evaluation_file", "purpose", "training_file", "n_pairs", "n_evaluation", "n_training")
