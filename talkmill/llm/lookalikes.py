"""One consistent form for texts that read the same but are made of different characters.

Per token: accents are taken off their letters, the set of scripts in which
each letter's look exists is intersected over the token, and the token is
spelled in a script of the intersection (one that shows it is a whole-script
confusable, several scripts in the raw token a mixed-script one). Which script
is chosen depends only on the looks, so equal looks give equal spellings. The
remaining forms (width, ligatures, spaces, hyphens, invisible characters,
composition of accents) are then normalised. Letter case, accents, digits and
wording stay as they are.

What looks alike is Unicode's public list of confusable characters, in the form
the ICU library brings along with Spark: the driver asks it for the prototype of
every letter and sign once and keeps those entries that respect case and digits
(``Looks``, a few thousand characters at most, whatever the data).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.plans.lineage import cut

# Letters that look like a Latin one though the public list gives them another prototype.
MORE = {"k": "кκĸ", "v": "ѵν", "y": "γ", "g": "ց", "Y": "Ү", "L": "Լ", "S": "Տ", "O": "Օ", "F": "Ϝ", "q": "զ"}
# Signs of the same look without an ASCII one.
SIGNS = {"·": "·"}
#: The script a token is spelled in where several would do; then in order of name.
FIRST = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_WIDTHS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def script_of(letter: str) -> str:
    """Name of a letter's script, the first word of its Unicode name."""
    return unicodedata.name(letter, "?").split(" ")[0].removesuffix("-")


@dataclass(frozen=True)
class Looks:
    """``letter``: the Latin letter that each look-alike letter looks like; ``sign``: the ASCII signs that each sign looks like."""

    letter: dict[str, str]
    sign: dict[str, str]
    spell: dict[str, dict[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """look -> script -> the letter to write in that script: the Latin letter itself, else the first by code point."""
        for c, look in [*((x, x) for x in sorted(set(self.letter.values()))), *sorted(self.letter.items())]:
            self.spell.setdefault(look, {}).setdefault(script_of(c), c)
            self.letter.setdefault(c, look)


@lru_cache(maxsize=1)
def looks(spark: SparkSession) -> Looks:
    """The table for this session's ICU. A letter looks like a Latin one of its own case only, and no letter or sign like a digit."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()

    def prototypes(characters: list[str]) -> dict[str, str]:
        return dict(zip(characters, checker.getSkeleton("\n".join(characters)).split("\n"), strict=True))

    of_ascii: dict[str, list[str]] = {}
    for c, prototype in prototypes([chr(c) for c in range(33, 127)]).items():
        of_ascii.setdefault(prototype, []).append(c)
    # Ideographs and syllables of the large blocks have no Latin look; surrogates are no characters.
    large = ((0x3400, 0x9FFF), (0xAC00, 0xDFFF), (0x17000, 0x18CFF), (0x20000, 0x3FFFF), (0xE0000, 0x10FFFF))
    others = [c for c in map(chr, range(0x80, 0xE0000)) if not any(a <= ord(c) <= b for a, b in large) and (unicodedata.category(c)[0] in "LPS") and unicodedata.normalize("NFD", c) == c]
    letter, sign = {}, {}
    for c, prototype in prototypes(others).items():
        kind, alike = unicodedata.category(c), of_ascii.get(prototype, [])
        fits = [x for x in alike if x.isalpha() and (x.isupper() == (kind == "Lu") or kind == "Lo")]
        if kind in ("Lu", "Ll", "Lo") and fits:
            letter[c] = fits[-1]
        elif kind[0] in "PS" or kind == "Lm":
            signs = [x for x in alike if not x.isalnum()]
            if signs or prototype and all(x.isascii() and not x.isalnum() for x in prototype):
                sign[c] = signs[0] if signs else prototype
    letter |= {c: latin for latin, alike in MORE.items() for c in alike}
    return Looks(letter, sign | SIGNS)


def resolved_scripts(token: str, table: Looks) -> set[str]:
    """Scripts in which every letter of a decomposed token has a letter of the same look."""
    left: set[str] | None = None
    for c in token:
        if unicodedata.combining(c):
            continue
        look = table.letter.get(c)
        found = set(table.spell[look]) if look else {script_of(c)}
        left = found if left is None else left & found
    return left or set()


def confusable_kind(token: str, table: Looks) -> str:
    """``mixed`` (letters of several scripts), ``whole`` (one script, but another has the same look) or ``single``."""
    letters = [c for c in unicodedata.normalize("NFD", token) if c.isalpha()]
    if len({script_of(c) for c in letters}) > 1:
        return "mixed"
    return "whole" if len(resolved_scripts("".join(letters), table)) > 1 else "single"


class Former:
    """Brings texts to their consistent form; keeps the spellings of the tokens it met, of which there are at most ``MOST`` at a time."""

    MOST = 200_000

    def __init__(self, table: Looks):
        self.table, self.spelled, self.folded = table, {}, {}

    def spell(self, token: str) -> str:
        """A decomposed token in its consistent script."""
        table = self.table
        scripts = resolved_scripts(token, table)
        chosen = next((s for s in (*FIRST, *sorted(scripts)) if s in scripts), "LATIN")
        return "".join(table.spell[table.letter[c]].get(chosen, table.letter[c]) if c in table.letter else c for c in token)

    def fold(self, c: str) -> str:
        """A character without regard to width, font and ligature; white space other than line ends becomes a plain space."""
        kind, _, codes = unicodedata.decomposition(c).partition(" ")
        # Width and font come before look. Of the other compatibility forms only ligatures and Roman numerals are letters joined as they are.
        if kind in _WIDTHS or kind == "<compat>" and ("ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ"):
            return "".join(self.fold(chr(int(x, 16))) if int(x, 16) > 127 else chr(int(x, 16)) for x in codes.split())
        if c in self.table.sign:
            return self.table.sign[c]
        category = unicodedata.category(c)
        if category == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️":
            return ""
        return " " if category == "Zs" else c

    def _token(self, m: re.Match[str]) -> str:
        token = m[0]
        if token.isascii():
            return token
        found = self.spelled.get(token)
        if found is None:
            if len(self.spelled) >= self.MOST:
                self.spelled.clear()
            found = self.spelled[token] = self.spell(token)
        return found

    def __call__(self, text: str) -> str:
        """The form shared by all texts that read like ``text``."""
        text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        if text.isascii():
            return text
        changed = {}
        for c in set(text):
            if not c.isascii():
                found = self.folded.get(c)
                if found is None:
                    found = self.folded[c] = self.fold(c)
                if found != c:
                    changed[ord(c)] = found
        folded = text.translate(changed) if changed else text
        if folded.isascii():
            return folded
        return unicodedata.normalize("NFC", _TOKEN.sub(self._token, unicodedata.normalize("NFD", folded)))


def with_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, form``: the consistent form of the whole text of each row; null stays null, an empty text empty."""
    kind, table = df.schema[key].dataType.simpleString(), looks(df.sparkSession)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(table)
        for batch in batches:
            done = pa.array([None if t is None else former(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), done], names=["key", "form"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(forms, f"key {kind}, form string").withColumnRenamed("key", key)


def reading_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_a, doc_b``: rows with different strings that read the same, the smaller key first.

    Rows meet on a digest of the form. Forms that occur with one string only,
    however many exact copies it has, are dropped before anything is paired; then
    distinct strings meet, and their rows are added, so rows of one string never meet each other. Null texts pair with nothing, repeated rows count once.
    """
    kind, table = df.schema[key].dataType.simpleString(), looks(df.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        former = Former(table)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            form = [blake2b(former(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            raw = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["key", "form", "raw"])

    present = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    rows = cut(present.mapInArrow(digests, f"key {kind}, form binary, raw binary"))
    several = rows.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x <> y").select("form")
    meets = rows.join(several, "form").distinct()
    strings = meets.select("form", "raw").distinct()
    ties = strings.toDF("form", "raw_a").join(strings.toDF("form", "raw_b"), "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    found = ties.join(meets.select(F.col("raw").alias("raw_a"), F.col("key").alias("a")), "raw_a").join(meets.select(F.col("raw").alias("raw_b"), F.col("key").alias("b")), "raw_b")
    return found.where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
