"""The registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontam, fingerprint, hardneg, htmlmain, kneser, langid, linededup, periodic, secretcrf, simhash, spm,
               toxicity, warc)
from .common import ship


def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {name: shipped(fn) for name, fn in {
    "op1_toxicity": toxicity.query,
    "op2_warc": warc.query,
    "op3_fingerprint": fingerprint.query,
    "op4_linededup": linededup.query,
    "op5_sentencepiece": spm.query,
    "op6_langid": langid.query,
    "op7_simhash": simhash.query,
    "op8_htmlmain": htmlmain.query,
    "op9_decontam": decontam.query,
    "op10_kneser": kneser.query,
    "op11_hardneg": hardneg.query,
    "op12_secrets": secretcrf.query,
    "op13_periodic": periodic.query,
}.items()}

ORACLE = {"op2_warc": warc.ORACLE, "op11_hardneg": hardneg.ORACLE}
