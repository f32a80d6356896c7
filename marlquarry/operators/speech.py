"""Text measures of speech and features of recordings."""

from __future__ import annotations

import difflib
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlquarry.functions.scalars import flags, norm_space


def spoken_words(text: Column) -> Column:
    return F.filter(F.split(norm_space(F.lower(F.coalesce(text, F.lit("")))), " "), lambda x: x != "")


def spoken_characters(text: Column) -> Column:
    """Letters and digits in lower case, nothing between them."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z가-힣]", "")


def character_error(reference: Column, heard: Column) -> Column:
    a, b = spoken_characters(reference), spoken_characters(heard)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))


def _as_letters(words: Column, both: Column) -> Column:
    """Each distinct word as a character of its own, so that an edit distance of words is one of characters.

    Up to 20,000 distinct words of a pair fit in the range from U+4E00 on.
    """
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex((19967 + F.array_position(both, w)).cast("long")), 4, "0")), "UTF-16BE")), "")


def word_error(reference: Column, heard: Column) -> Column:
    a, b = spoken_words(reference), spoken_words(heard)
    both = F.array_distinct(F.concat(a, b))
    return F.levenshtein(_as_letters(a, both), _as_letters(b, both)) / F.greatest(F.size(a), F.lit(1))


def error_rates(pairs: DataFrame) -> DataFrame:
    """pairs (key columns, reference, heard) with cer and wer."""
    keys = [c for c in pairs.columns if c not in ("reference", "heard")]
    rows = pairs.withColumn("a", spoken_words(F.col("reference"))).withColumn("b", spoken_words(F.col("heard")))
    rows = rows.withColumn("both", F.array_distinct(F.concat("a", "b")))
    wer = F.levenshtein(_as_letters(F.col("a"), F.col("both")), _as_letters(F.col("b"), F.col("both"))) / F.greatest(F.size("a"), F.lit(1))
    return rows.select(*keys, F.round(character_error(F.col("reference"), F.col("heard")), 6).alias("cer"), F.round(wer, 6).alias("wer"))


def name_accuracy(text: Column, names: Column) -> Column:
    """Share of names that the text holds; 1 where there are none."""
    return F.coalesce(F.size(F.filter(names, lambda n: F.contains(text, n))) / F.nullif(F.size(names), F.lit(0)), F.lit(1.0))


def character_f1(pairs: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of the multisets of characters of reference and heard."""
    chars = lambda c: pairs.select(key, F.explode(F.filter(F.split(spoken_characters(F.col(c)), ""), lambda x: x != "")).alias("ch")).groupBy(key, "ch").agg(F.count("*").alias(c))
    both = chars("reference").join(chars("heard"), [key, "ch"], "full_outer").fillna(0, ["reference", "heard"])
    sums = both.groupBy(key).agg(F.sum(F.least("reference", "heard")).alias("same"), F.sum("reference").alias("r"), F.sum("heard").alias("h"))
    p = F.coalesce(F.col("same") / F.nullif(F.col("h"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("same") / F.nullif(F.col("r"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    rows = pairs.select(key).join(sums, key, "left")
    return rows.select(key, *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in (("char_precision", p), ("char_recall", r), ("char_f1", f1))))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(reference: pd.Series, heard: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in function has."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in zip(reference, heard, strict=True)])


WAV = "id string, ok boolean, rate int, channels int, duration_ms double, rms_dbfs double, peak double, clipping double, silence double, lead_ms double, tail_ms double"


def wav_features(files: DataFrame, quiet: float = 0.01) -> DataFrame:
    """Features of PCM recordings (id, content): length, loudness, peak, clipped and silent shares, silence at the edges.

    A file that is no PCM WAV has ok false and nulls.
    """

    def one(key: str, content: bytes) -> tuple:
        try:
            with wave.open(io.BytesIO(content)) as w:
                rate, channels, width, data = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
        except (wave.Error, EOFError, TypeError):
            return (key, False, *[None] * 9)
        kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}.get(width)
        if kind is None:
            return (key, False, *[None] * 9)
        x = np.frombuffer(data, kind).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
        if not len(x):
            return (key, True, rate, channels, 0.0, None, 0.0, 0.0, 1.0, 0.0, 0.0)
        loud = np.flatnonzero(np.abs(x) >= quiet)
        lead, tail = (loud[0], len(x) - 1 - loud[-1]) if len(loud) else (len(x), len(x))
        rms = float(np.sqrt(np.mean(x**2)))
        return (key, True, rate, channels, 1000 * len(x) / rate, 20 * float(np.log10(rms)) if rms > 0 else None, float(np.abs(x).max()), float((np.abs(x) >= 0.999).mean()), float((np.abs(x) < quiet).mean()), 1000 * lead / rate, 1000 * tail / rate)

    def run(parts):
        for part in parts:
            yield pd.DataFrame([one(k, c) for k, c in zip(part["id"], part["content"], strict=True)], columns=[x.split()[0] for x in WAV.split(", ")])

    return files.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(run, WAV)


def resample_linear(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = max(1, round(len(x) * target / rate))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x) if len(x) else x


def model_deltas(runs: DataFrame, baseline: str = "tiny") -> DataFrame:
    """Error and latency of each model less the baseline's, a decision, and whether it is the one to recommend.

    runs: model, cer, wer, p95_ms. Of models with p95 of 3,000 ms at most the least cer wins, then wer, then the name.
    """
    base = runs.filter(F.col("model") == baseline).select(*(F.col(c).alias(f"b_{c}") for c in ("cer", "wer", "p95_ms"))).limit(1)
    rows = runs.join(base).select("*", *(F.round(F.col(c) - F.col(f"b_{c}"), 6).alias(f"delta_{c}") for c in ("cer", "wer", "p95_ms")))
    reasons = flags(cer_regression=F.col("delta_cer") > 0, wer_regression=F.col("delta_wer") > 0, too_slow=F.col("p95_ms") > 3000)
    place = F.row_number().over(Window.orderBy(F.col("p95_ms") > 3000, "cer", "wer", "model"))
    return rows.select("model", "delta_cer", "delta_wer", "delta_p95_ms", F.array_join(reasons, ",").alias("reasons"), (place == 1).alias("recommended"))
