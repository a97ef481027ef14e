"""Searchable text of a note, and the normal form in which texts and search terms are compared.

Normal form: NFKC, lower case character by character, runs of white space as one
space, none at the ends.  Texts and terms are brought there in the JVM, by built-in
functions and, where they aren't ASCII only, by the ICU that Spark brings.  No text
goes to Python but over Spark Connect, where no JVM is at hand: there by a pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import tags as tag
from tidelog.schema import LONG_FORM, PROFILE

# fixed value: stands between the fields of a text, so that no term matches over two of them
FIELD_END = "\x1f"
#: Goes up whenever the normal form or the choice of texts changes, so that stores know which texts are of which form.
VERSION = 2
#: A column that notes may have: contents that are folded already, but those of profiles as they are.
FOLDED = "content_folded"
#: Bytes of texts that a Python worker is given at once.
BATCH_BYTES = 8 << 20
# fixed values
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The white space that NFKC leaves, but for the space itself.
LEFT_SPACE = "\t\n\v\f\r\x85\u1680\u2028\u2029"
CAPITAL_SIGMA, SMALL_SIGMA = "\u03a3", "\u03c3"
TITLE_TAGS = ("title", "Title", "summary", "Summary")
_RUN = re.compile(f"[{WHITE_SPACE}]+")


def _jvm():
    """The driver's JVM; none over Spark Connect and in Python workers."""
    context = SparkContext._active_spark_context
    return context._jvm if context is not None else None


def fold(text: str) -> str:
    """NFKC and lower case.  Only capital sigma has a small letter that depends on its neighbours."""
    jvm = None if text.isascii() else _jvm()
    if jvm is None:
        return unicodedata.normalize("NFKC", text).replace(CAPITAL_SIGMA, SMALL_SIGMA).lower()
    # as _folded_there has it: ICU can know letters that Python doesn't know yet
    composed = jvm.com.ibm.icu.text.Normalizer.compose(text, True).replace(CAPITAL_SIGMA, SMALL_SIGMA)
    return jvm.com.ibm.icu.lang.UCharacter.toLowerCase(jvm.com.ibm.icu.util.ULocale.ROOT, composed)


def normalise(text: str) -> str:
    return _RUN.sub(" ", fold(text)).strip(" ")


def _each_once(change: Callable[[str], str], texts: pd.Series) -> pd.Series:
    """``change`` of every text, made once for equal ones."""
    made = {t: change(t) for t in texts.dropna().unique()}
    return texts.map(made.__getitem__, na_action="ignore")


def bound_batches(spark: SparkSession) -> None:
    """Texts differ in length by thousands, so a Python worker takes them by bytes, and fewer than Spark's 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) in (-1, 64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def terms(search: str | None) -> list[str]:
    return [t for t in normalise(search or "").split(" ") if t]


@F.pandas_udf(T.StringType())
def _normalised(texts: pd.Series) -> pd.Series:
    return _each_once(normalise, texts)


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return _each_once(fold, texts)


#: So named that the optimiser makes the text once and doesn't copy it into every condition on it.
_folded = _folded.asNondeterministic()


class _Calls:
    """Calls of the JVM's methods on a text that are compiled into the query.  Unlike ``reflect`` they count as
    deterministic, so conditions on other columns still reach the scan below them."""

    def __init__(self, jvm, text: Column):
        self.jvm, self.made, self.types = jvm, jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types
        self.column = jvm.org.apache.spark.sql.classic.ExpressionUtils
        self.string = self._object("java.lang.String")
        self.text = self._of_it("toString", self.column.expression(text._jc))

    def _object(self, name: str):
        return self.types.ObjectType(self.jvm.java.lang.Class.forName(name))

    def _listed(self, *given):
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(list(given))

    def _of_it(self, method: str, target, *given):
        return self.made.objects.Invoke(target, method, self.string, self._listed(*given), self._listed(), True, True, True)

    def _static(self, name: str, method: str, kind, *given):
        return self.made.objects.StaticInvoke(self.jvm.java.lang.Class.forName(name), kind, method, self._listed(*given), self._listed(), True, True, True, self.jvm.scala.Option.empty())

    def replaced(self, old: str, new: str) -> _Calls:
        self.text = self._of_it("replace", self.text, self.made.Literal(old, self.string), self.made.Literal(new, self.string))
        return self

    def composed(self) -> _Calls:
        self.text = self._static("com.ibm.icu.text.Normalizer", "compose", self.string, self.text, self.made.Literal.TrueLiteral())
        return self

    def lower(self) -> _Calls:
        root = self.made.Literal(self.jvm.com.ibm.icu.util.ULocale.ROOT, self._object("com.ibm.icu.util.ULocale"))
        self.text = self._static("com.ibm.icu.lang.UCharacter", "toLowerCase", self.string, root, self.text)
        return self

    def done(self) -> Column:
        return Column(self.column.column(self._static("org.apache.spark.unsafe.types.UTF8String", "fromString", self.types.DataType.fromDDL("string"), self.text)))


def _either(text: Column, plain: Column, other) -> Column:
    """``plain`` for texts of ASCII only, the UDF ``other`` (which gets nulls in their place) for the rest."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(text.isNull() | ascii_only, plain).otherwise(other(F.when(~ascii_only, text)))


def _folded_there(jvm, text: Column) -> Column:
    """``fold`` in the JVM."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(text.isNull() | ascii_only, F.lower(text)).otherwise(_Calls(jvm, text).composed().replaced(CAPITAL_SIGMA, SMALL_SIGMA).lower().done())


def normalised(text: Column) -> Column:
    if (jvm := _jvm()) is None:
        return _either(text, F.trim(F.regexp_replace(F.lower(text), "[\t-\r ]+", " ")), _normalised)
    # a pattern for all white space would take longer than the rest of this together
    calls = _Calls(jvm, _folded_there(jvm, text))
    for one in LEFT_SPACE:
        calls.replaced(one, " ")
    return F.trim(F.regexp_replace(calls.done(), "  +", " "))


def folded(text: Column) -> Column:
    """As ``normalised`` but with white space as it is.  Terms hold none, so they match this just as well, for less work.

    So written that the optimiser makes the text once and doesn't copy it into every condition on it.
    """
    if (jvm := _jvm()) is not None:
        return F.when(F.spark_partition_id() >= 0, _folded_there(jvm, text))
    return _either(text, F.lower(text), _folded)


def raw_text(kind: Column, content: Column, tags: Column) -> Column:
    """String members of a profile's JSON object; body, titles and summaries of a long-form note; else the content."""
    members = F.map_filter(F.from_json(content, "map<string,variant>"), lambda k, v: F.schema_of_variant(v) == "STRING")
    profile = F.coalesce(F.array_join(F.transform(F.map_values(members), lambda v: F.variant_get(v, "$", "string")), FIELD_END), F.lit(""))
    titles = F.transform(F.filter(tags, lambda t: tag.name_of(t).isin(*TITLE_TAGS) & tag.value_of(t).isNotNull()), tag.value_of)
    article = F.array_join(F.concat(F.array(F.coalesce(content, F.lit(""))), F.coalesce(titles, F.array().cast("array<string>"))), FIELD_END)
    return F.when(kind == PROFILE, profile).when(kind == LONG_FORM, article).otherwise(F.coalesce(content, F.lit("")))


def search_text(kind: Column = None, content: Column = None, tags: Column = None) -> Column:
    kind, content, tags = (F.col(n) if c is None else c for n, c in (("kind", kind), ("content", content), ("tags", tags)))
    return normalised(raw_text(kind, content, tags))


def matchable_text(folded_content: Column | None = None) -> Column:
    """``folded_content``: the column FOLDED, if there is one.  Nothing is composed over a FIELD_END, so only the rest
    of a text is folded then."""
    kind, content, tags = F.col("kind"), F.col("content"), F.col("tags")
    if folded_content is None:
        return folded(raw_text(kind, content, tags))
    body = F.coalesce(folded_content, F.lit(""))
    rest = folded(raw_text(kind, F.when(kind == PROFILE, folded_content), tags))
    return F.when(kind == PROFILE, rest).when(kind == LONG_FORM, F.concat(body, rest)).otherwise(body)
