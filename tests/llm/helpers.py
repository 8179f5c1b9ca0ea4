"""Rows with everything that may go wrong, and small readers."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names the operators use inside, as columns of the input
CLASHES = ("k1 k2 key host node grams bands band hub root h p lo hi at w doc raw spans id bucket size shard slot n rank "
           "length piece line lines drop page payload digest keeper class_id n_links score kept held_out "
           "lang_pred predicted weight words item_id cosine lcs answer").split()

PROSE = ("the river ran past a mill where old men sold bread and salt to anyone with coins while children threw stones "
         "at the ducks until evening came and every lamp along the quay was lit by a woman who never spoke").split()


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(PROSE) + draw.choice(["", "s", "ed", "ing"]) for _ in range(n))


def awkward_rows():
    long = prose(40_000, 1)
    twin = prose(120, 2)
    return [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "ok", "en", "a", 2),
            (5, long, "en", "b", len(long)), (6, twin, "en", "a", len(twin)), (7, twin, "fr", "b", None),
            (7, twin, "fr", "b", None), (None, twin, None, None, None), (None, None, None, None, None),
            (8, "x" * 3000, "en", "a", 3000), (9, "éß中 " * 400, "de", "a", 2000), (10, "\n".join(["menu"] * 60), "en", "a", 0),
            (11, "### $$$ 123    ", "es", "a", 5), (12, prose(80, 3) + "\r\nWARC/1.0\r\n\r\n", "en", "a", 1)]


def awkward(spark, rows=None):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


def empty(spark):
    return awkward(spark, [])


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
