"""Filters, sampling, splits, rebalancing and keyed assembly of pair tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize


def document_pairs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Adjacent documents as pairs (id, qid1, qid2, question1, question2, is_duplicate); the label is the first one's quality."""
    a = documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("qid1"), F.col("text").alias("question1"))
    b = documents.select((F.col("doc_id") - 1).alias("id"), F.col("doc_id").alias("qid2"), F.col("text").alias("question2"))
    said = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("is_duplicate"))
    # dealt by id, as the join and the features that group by id need them, even where one side could be broadcast
    return a.repartition("id").join(b.repartition("id"), "id").join(said, "id", "left").select("id", "qid1", "qid2", "question1", "question2", "is_duplicate")


def unify(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both as one table: test's test_id is id, its label -1."""
    return train.unionByName(test.withColumnRenamed("test_id", "id").withColumn("is_duplicate", F.lit(-1)), allowMissingColumns=True)


def apart(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What unify joined: (train, test); rows without a label belong to neither."""
    return both.filter("is_duplicate >= 0"), both.filter("is_duplicate < 0").withColumnRenamed("id", "test_id").drop("is_duplicate")


def membership(df: DataFrame, key: str, members: DataFrame, name: str) -> DataFrame:
    """Adds whether the key is among the values of members' only column; a null key is not."""
    there = members.select(F.col(members.columns[0]).alias("__member")).distinct()
    return df.join(there, F.col(key) == F.col("__member"), "left").withColumn(name, F.col("__member").isNotNull()).drop("__member")


def drop_short(pairs: DataFrame, least: int = 9) -> DataFrame:
    return pairs.filter((F.length("question1") >= least) & (F.length("question2") >= least))


def number_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds nth, from 1 within each group, and of, the group's size, without a window over a whole group.

    Rows are ranged by the order first; numbers are those in the range plus the sizes of the ranges before.
    The ranges are written, as a second plan of them would draw other bounds. Rows that tie are numbered in any order.
    """
    ranged = materialize(df.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy(group, "__part").orderBy(order)
    sizes = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy(group)).alias("of"))
    own = ranged.withColumn("__nth", F.row_number().over(w))
    out = own.join(base, own[group].eqNullSafe(base["__g"]) & (own["__part"] == base["__p"]))
    return out.withColumn("nth", F.col("__nth") + F.col("__base")).drop("__g", "__p", "__part", "__nth", "__base")


def rebalance(pairs: DataFrame, share: float = 0.8) -> DataFrame:
    """Negatives, the first share of positives in order of id, and negatives again; copy tells the two apart."""
    numbered = number_within(pairs.filter("is_duplicate IS NOT NULL"), "is_duplicate", "id")
    negatives = numbered.filter("is_duplicate = 0")
    positives = numbered.filter((F.col("is_duplicate") == 1) & (F.col("nth") <= F.floor(F.col("of") * share)))
    parts = [x.withColumn("copy", F.lit(k)) for x, k in ((negatives, 0), (positives, 0), (negatives, 1))]
    return reduce(DataFrame.unionByName, parts).drop("nth", "of")


def rebalanced_validation(pairs: DataFrame, test_share: float = 0.1, share: float = 0.8, seed: int = 4242) -> DataFrame:
    """Training and validation rows (is_test), each rebalanced for itself."""
    parts = [rebalance(split(pairs, test_share, seed).filter(F.col("is_test") == k), share) for k in (False, True)]
    return parts[0].unionByName(parts[1])


def symmetrized(pairs: DataFrame) -> DataFrame:
    swapped = {"qid1": "qid2", "qid2": "qid1", "question1": "question2", "question2": "question1"}
    return pairs.withColumn("swapped", F.lit(0)).unionByName(pairs.select(*(F.col(swapped.get(c, c)).alias(c) for c in pairs.columns), F.lit(1).alias("swapped")))


def oversample_positives(pairs: DataFrame, key: Column) -> DataFrame:
    """Adds round(0.5 N - D) positives, those of smallest key (ties by id), as copy 1; N pairs, D positives."""
    return pairs.withColumn("copy", F.lit(0)).unionByName(drawn_positives(pairs, key).withColumn("copy", F.lit(1)))


def drawn_positives(pairs: DataFrame, key: Column) -> DataFrame:
    n, d = pairs.agg(F.count("*"), F.count_if(F.col("is_duplicate") == 1)).first()
    more = max(0, min(d, int(0.5 * n - d + 0.5)))
    positives = pairs.filter("is_duplicate = 1").withColumn("__key", F.struct(key.alias("key"), F.col("id").alias("id"))).withColumn("__all", F.lit(0))
    return number_within(positives, "__all", "__key").filter(F.col("nth") <= more).drop("nth", "of", "__key", "__all")


def synonym_choice(lexicon: DataFrame, seed: int = 4242) -> DataFrame:
    """(word, synonym) out of (word, pos, lemma): for nouns and adjectives, the lemma of smallest hash; blanks for underscores. Words that stand for entities keep themselves."""
    kept = F.col("word").isin(sorted(set(ENTITY_WORDS.values())))
    rank = F.struct(F.md5(F.concat_ws(":", F.lit(seed), "word", "lemma").cast("binary")).alias("h"), "lemma")
    named = lexicon.filter(F.upper("pos").isin("NOUN", "ADJ") & F.col("lemma").isNotNull() & ~kept)
    return named.groupBy("word").agg(F.regexp_replace(F.min(rank)["lemma"], "_", " ").alias("synonym"))


def with_synonyms(pairs: DataFrame, synonyms: DataFrame, columns: tuple[str, ...] = ("question1", "question2")) -> DataFrame:
    """Words of the texts (split at single blanks) that have a synonym, replaced by it: not the first and the last word, which no blank surrounds. A null text stays."""
    kind = "array<struct<side:int,at:int,word:string,inner:boolean>>"
    told = lambda c, side: F.coalesce(F.transform(F.split(c, " "), lambda w, at: F.struct(F.lit(side).alias("side"), at.alias("at"), w.alias("word"), ((at > 0) & (at < F.size(F.split(c, " ")) - 1)).alias("inner"))).cast(kind), F.array().cast(kind))
    words = pairs.select("id", F.inline(F.concat(*(told(c, k) for k, c in enumerate(columns)))))
    said = words.filter("inner").join(synonyms, "word", "left").select("id", "side", "at", F.coalesce("synonym", "word").alias("w")).union(words.filter("NOT inner").select("id", "side", "at", "word"))
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("at", "w")))), lambda x: x["w"]), " ")
    put = said.groupBy("id").agg(*(text(k).alias(f"__{c}") for k, c in enumerate(columns)))
    new = {c: F.when(F.col(c).isNotNull(), F.col(f"__{c}")).alias(c) for c in columns}
    return pairs.join(put, "id", "left").select(*(new.get(c, F.col(c)) for c in pairs.columns))


def oversample_synonymised(pairs: DataFrame, key: Column, lexicon: DataFrame, seed: int = 4242) -> DataFrame:
    """As oversample_positives, but the added pairs have synonyms for their nouns and adjectives. Ids must be unique."""
    more = materialize(drawn_positives(pairs, key))
    return pairs.withColumn("copy", F.lit(0)).unionByName(with_synonyms(more, synonym_choice(lexicon, seed)).withColumn("copy", F.lit(1)))


def hash_share(key: str, seed: int = 4242) -> Column:
    """A number in [0, 1) that follows from the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def split(pairs: DataFrame, test_share: float = 0.1, seed: int = 4242) -> DataFrame:
    """Adds is_test, by a hash of id."""
    return pairs.withColumn("is_test", hash_share("id", seed) < test_share)


def folds(pairs: DataFrame, k: int) -> DataFrame:
    """Adds fold: within each label in turn by id."""
    return number_within(pairs, "is_duplicate", "id").withColumn("fold", ((F.col("nth") - 1) % k).cast("int")).drop("nth", "of")


def assemble(base: DataFrame, families: list[DataFrame], fill: float = 0.0) -> DataFrame:
    """base with every family's columns by id; missing, NaN and infinite numbers become fill."""
    out = reduce(lambda a, b: a.join(b, "id", "left"), families, base)
    fixed = {}
    for f in families:
        for c, kind in f.dtypes:
            if c != "id" and kind in ("double", "float"):
                fixed[c] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), fill).otherwise(F.coalesce(c, F.lit(fill)))
            elif c != "id" and kind in ("int", "bigint"):
                fixed[c] = F.coalesce(F.col(c), F.lit(int(fill)).cast(kind))
    return out.withColumns(fixed)


def inner_features(frames: dict[str, DataFrame]) -> DataFrame:
    """Inner join of external feature tables by id; a table of one column besides gets its name (a file's stem), one of several puts it before theirs."""
    named = []
    for stem, df in frames.items():
        own = [c for c in df.columns if c != "id"]
        named.append(df.select("id", *(F.col(c).alias(stem if len(own) == 1 else f"{stem}_{c}") for c in own)))
    return reduce(lambda a, b: a.join(b, "id"), named)


def aligned(ids: DataFrame, features: DataFrame, fill: float = 0.0) -> DataFrame:
    """features for every id; columns of ids that features lack get fill, stored nulls stay."""
    there = features.withColumn("__there", F.lit(True))
    out = ids.select("id").join(there, "id", "left")
    return out.select("id", *(F.when(F.col("__there"), F.col(c)).otherwise(F.lit(fill)).alias(c) for c in features.columns if c != "id"))


def vocabulary(pairs: DataFrame) -> DataFrame:
    """The distinct words of both texts, split at single blanks."""
    words = lambda c: pairs.select(F.explode(F.split(c, " ")).alias("word"))
    return words("question1").union(words("question2")).distinct()


def entity_choice(tagged: DataFrame) -> DataFrame:
    """(token, first, second): a token's entity types by how often it has them; '' counts half, and a second needs more than 2."""
    counts = tagged.groupBy("token", "ent_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("token").orderBy(F.desc(F.when(F.col("ent_type") == "", F.col("n") * 0.5).otherwise(F.col("n").cast("double"))), "ent_type")
    top = counts.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    return top.groupBy("token").agg(F.max(F.when(F.col("k") == 1, F.col("ent_type"))).alias("first"), F.max(F.when((F.col("k") == 2) & (F.col("n") > 2), F.col("ent_type"))).alias("second"))


# Entity labels and the words that stand for them.
ENTITY_WORDS = {
    "": "",
    "PERSON": "person",
    "NORP": "nationality",
    "FAC": "facility",
    "ORG": "organization",
    "GPE": "country",
    "LOC": "location",
    "PRODUCT": "product",
    "EVENT": "event",
    "WORK_OF_ART": "artwork",
    "LANGUAGE": "language",
    "DATE": "date",
    "TIME": "time",
    "LAW": "law",
    "PERCENT": "number",
    "MONEY": "number",
    "QUANTITY": "number",
    "ORDINAL": "number",
    "CARDINAL": "number",
}


# Entity labels that stand for numbers.
NUMERIC_TYPES = ("DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL")
# Words that cleanup puts for what it takes out.
SPECIAL_TOKENS = ("quoted_item", "non_ascii_word", "something")


def entity_text(tokens: Column, special: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Tokens with their entities as words: a scan from left to right that knows the type of the token before.

    A token is a struct of text and ent (its entity type here, '' if none) and, where the tables have
    them, type (what it mostly is), second (its second type), lemma, known and lemma_known (whether text
    and lemma have vectors). By order of the rules: special tokens stay, or give their type; what does not
    begin with a letter or digit, and a lone s, goes; a token of the type before it goes, as do numbers
    after numbers; digits become 'number'; a token with a type becomes its word; one with a second type
    and capitals inside becomes that word; others become their lemma if that has a vector, else their
    second type's word, else their lower-case form.
    """
    names = F.create_map(*(F.lit(x) for kv in ENTITY_WORDS.items() for x in kv))
    state = F.struct(F.lit(None).cast("string").alias("before"), F.array().cast("array<string>").alias("words"))
    word = lambda kind: F.coalesce(F.try_element_at(names, kind), kind)
    numeric = lambda kind: F.coalesce(kind.isin(*NUMERIC_TYPES), F.lit(False))

    def add(s: Column, t: Column) -> Column:
        text, here, before = t["text"], t["ent"], s["before"]
        kind = F.when(F.coalesce(t["type"], F.lit("")) == "", here).otherwise(t["type"])
        second, lemma = F.coalesce(t["second"], F.lit("")), F.coalesce(t["lemma"], F.lower(text))
        step = lambda kind, said: F.struct(kind.cast("string").alias("before"), F.concat(s["words"], said).alias("words"))
        none, put = F.lit(None).cast("string"), lambda x: F.array(x)
        nothing = F.array().cast("array<string>")
        same = F.coalesce((kind == before) | (here == before), F.lit(False)) | (numeric(before) & (numeric(kind) | numeric(here)))
        proper = (F.lower(text) == lemma) & (F.substring(text, 2, 1_000_000) != F.substring(lemma, 2, 1_000_000)) & (second != "")
        return (
            F.when(text.isin(*special), F.when(here != "", step(here, put(here))).otherwise(step(none, put(text))))
            .when(~F.coalesce(F.regexp_like(text, F.lit(r"^[\p{L}\p{N}]")), F.lit(False)) | (text == "s"), step(none, nothing))
            .when(same, step(before, nothing))
            .when(F.regexp_like(text, F.lit(r"^\p{Nd}+$")), F.when(numeric(before), step(before, nothing)).otherwise(step(F.lit("QUANTITY"), put(F.lit("number")))))
            .when(kind != "", step(kind, put(word(kind))))
            .when(proper, step(second, put(word(second))))
            .when(F.coalesce(t["lemma_known"], F.lit(True)), step(none, put(lemma)))
            .when(second != "", step(second, put(word(second))))
            .when(F.coalesce(t["known"], F.lit(False)), step(none, put(F.lower(text))))
            .otherwise(step(none, put(text)))
        )

    full = F.transform(tokens, lambda t: F.struct(*(t[c].cast(k).alias(c) for c, k in (("text", "string"), ("ent", "string"), ("type", "string"), ("second", "string"), ("lemma", "string"), ("known", "boolean"), ("lemma_known", "boolean")))))
    return F.array_join(F.aggregate(full, state, add)["words"], " ")


def token_facts(text: str | None, ent: str | None, kind: str | None = None, second: str | None = None, lemma: str | None = None, known: bool | None = None, lemma_known: bool | None = None) -> Column:
    """One token for entity_text, from literals."""
    kinds = (("text", "string"), ("ent", "string"), ("type", "string"), ("second", "string"), ("lemma", "string"), ("known", "boolean"), ("lemma_known", "boolean"))
    return F.struct(*(F.lit(v).cast(k).alias(c) for v, (c, k) in zip((text, ent, kind, second, lemma, known, lemma_known), kinds, strict=True)))
