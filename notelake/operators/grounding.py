"""Whether what an answer says stands in the notes that it cites."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import assets_in, numbers_in, polarity

CITATION = r"\[([0-9]+)\]"
_CUT = "\x01"


def sentences(text: Column) -> Column:
    """A text cut at white space behind . ! or ?."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + _CUT), _CUT)


def _facts(text: Column) -> Column:
    """Numbers and asset tags, told apart by a letter in front."""
    mark = lambda c, letter: F.transform(c, lambda x: F.concat(F.lit(letter), x))
    return F.concat(mark(numbers_in(text), "n"), mark(assets_in(text), "a"))


def check(answers: DataFrame, notes: DataFrame) -> DataFrame:
    """answer_id, sentences and grounded for each row of ``answers`` (answer_id, set_id, upto, question, answer) over ``notes`` (set_id, n, text).

    An answer may use the notes 1 to ``upto`` of its set. Each sentence's
    numbers and asset tags must stand in the notes it cites, or, where it cites
    none, in any note it may use, or in the question. A citation of a note that
    is not there fails; so does a cited sentence whose verdicts all differ from
    those of its notes, if these have any. For sentences without a citation the
    first note of each fact is looked up, so notes are not multiplied by answers.
    answer_id is unique; a null set_id is a set like any other.
    """
    # Structs are equal where their nulls are.
    answers, notes = (df.withColumn("set_id", F.struct(F.col("set_id").alias("id"))) for df in (answers, notes))
    rows = answers.select("answer_id", "set_id", "upto", F.coalesce("question", F.lit("")).alias("question"), F.posexplode(sentences(F.coalesce("answer", F.lit("")))).alias("s", "sentence"))
    cited = F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("long")))
    plain = F.regexp_replace("sentence", CITATION, " ")
    rows = rows.withColumn("cited", cited).withColumn("plain", plain)
    rows = rows.select("answer_id", "set_id", "upto", "s", "cited", F.array_except(_facts(F.col("plain")), _facts(F.col("question"))).alias("facts"), polarity(F.col("plain")).alias("claims"))
    noted = notes.where("text is not null").select("set_id", "n", _facts(F.col("text")).alias("facts_"), polarity(F.col("text")).alias("says"))
    bad_number = F.exists("cited", lambda n: n.isNull() | (n < 1) | (n > F.col("upto")))

    first = noted.select("set_id", "n", F.explode("facts_").alias("fact")).groupBy("set_id", "fact").agg(F.min("n").alias("first"))
    free = rows.where(F.size("cited") == 0).select("answer_id", "upto", "set_id", F.explode("facts").alias("fact"))
    unseen = free.join(first, ["set_id", "fact"], "left").where("first is null or first > upto").select("answer_id").distinct()

    bound = rows.where(F.size("cited") > 0).withColumn("off", bad_number)
    source = bound.where("not off").select("answer_id", "s", "set_id", "facts", "claims", F.explode("cited").alias("n")).join(noted, ["set_id", "n"], "left")
    per = source.groupBy("answer_id", "s").agg(F.first("facts").alias("facts"), F.first("claims").alias("claims"), F.flatten(F.collect_list("facts_")).alias("allowed"), F.flatten(F.collect_list("says")).alias("says"))
    wrong = (F.size(F.array_except("facts", "allowed")) > 0) | ((F.size("claims") > 0) & (F.size("says") > 0) & ~F.arrays_overlap("claims", "says"))
    failed = unseen.unionByName(bound.where("off").select("answer_id")).unionByName(per.where(wrong).select("answer_id")).distinct().withColumn("failed", F.lit(True))
    counted = rows.groupBy("answer_id").agg(F.count("*").alias("sentences"))
    return counted.join(failed, "answer_id", "left").select("answer_id", "sentences", F.col("failed").isNull().alias("grounded"))
