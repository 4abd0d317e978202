"""Fill-in-the-middle training texts: a document is cut at two unit boundaries and its parts are reordered.

Units are described by a grammar: character classes that share out all characters, and alternatives, each a
sequence of classes with a count (``1``, ``+`` or ``*``). ``boundary`` translates a grammar into one zero-width
regular expression of neighbouring classes, ``(?<=[..])(?=[..])``: it matches between two characters exactly
if no alternative lets the second follow the first within a unit. Spark's ``split`` at that expression loses no
character, so joining the pieces gives the text. A grammar whose units cannot be told from neighbouring
characters is refused: the translation is compared with the alternatives on all short strings of classes.

Which form a document takes and where it is cut follow from the SHA-256 of ``seed:id``: h1 to h4 are its first
four groups of eight hex digits. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) of n units, the
middle after the larger. A text that is empty or holds a marker stays ``plain``, as do those with h3 % 100 at or above
``fim_percent``; h4 % 100 decides between suffix-prefix-middle (``spm``) and prefix-suffix-middle (``psm``).

Edge cases: a null text is an empty one (no units, plain). A null id is the empty string in the seed. Rows that
repeat an id are cut by the same hashes, each at its own units. Extra columns are never read, except that
``transform`` carries those it is asked to keep. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42


@dataclass(frozen=True)
class Grammar:
    """``classes``: name to the inside of a bracket expression; ``units``: alternatives such as ``"space* other+"``, tried in order."""

    classes: tuple[tuple[str, str], ...]
    units: tuple[str, ...]


_SPACE = "\\x20\\x09-\\x0D"
GRAMMARS = {
    # A word with the white space before it; white space at the end of a text is a unit of its own.
    "words": Grammar((("space", _SPACE), ("other", f"^{_SPACE}")), ("space* other+", "space+")),
    # A line with its line feed.
    "lines": Grammar((("feed", "\\n"), ("other", "^\\n")), ("other* feed", "other+")),
    # Runs of white space and of everything else.
    "runs": Grammar((("space", _SPACE), ("other", f"^{_SPACE}")), ("other+", "space+")),
    "characters": Grammar((("any", "\\s\\S"),), ("any",)),
}


def _steps(unit: str) -> list[tuple[str, str]]:
    return [(s.rstrip("+*"), s[-1] if s[-1] in "+*" else "1") for s in unit.split()]


def _following(grammar: Grammar) -> set[tuple[str, str]]:
    """Pairs of classes that may be neighbours within a unit."""
    pairs = set()
    for unit in grammar.units:
        steps = _steps(unit)
        for i, (a, many) in enumerate(steps):
            if many != "1":
                pairs.add((a, a))
            for b, count in steps[i + 1 :]:
                pairs.add((a, b))
                if count != "*":
                    break
    return pairs


def _is_local(grammar: Grammar, cuts: set[tuple[str, str]]) -> bool:
    """Whether cutting between neighbours gives the units of the alternatives on all strings of up to six classes."""
    letter = {name: chr(97 + i) for i, (name, _) in enumerate(grammar.classes)}
    pattern = re.compile("|".join("".join(letter[a] + ("" if k == "1" else k) for a, k in _steps(u)) for u in grammar.units))
    near = {letter[a] + letter[b] for a, b in cuts}
    for n in range(1, 7):
        for chosen in product(letter.values(), repeat=n):
            text = "".join(chosen)
            ends = [m.end() for m in pattern.finditer(text)]
            if "".join(pattern.findall(text)) != text or ends[:-1] != [i for i in range(1, n) if text[i - 1 : i + 1] in near]:
                return False
    return True


def boundary(grammar: Grammar) -> str:
    """A zero-width regular expression that matches between units."""
    names = [name for name, _ in grammar.classes]
    follow = _following(grammar)
    cuts = {(a, b) for a in names for b in names if (a, b) not in follow}
    if not _is_local(grammar, cuts):
        raise ValueError("the units of this grammar do not follow from neighbouring characters")
    inside = dict(grammar.classes)
    # A code point beyond the basic plane is two characters to the regular expression: never cut before its second half.
    whole = "(?![\\x{DC00}-\\x{DFFF}])"
    pairs = [f"(?<=[{inside[a]}])(?=[{inside[b]}]){whole if inside[b] == '\\s\\S' or inside[b][0] == '^' else ''}" for a, b in sorted(cuts)]
    return "|".join(pairs)


def pieces(text: Column, grammar: Grammar) -> Column:
    """The units of a text, which joined give it back; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", units: str | Grammar = "words", fim_percent: int = 50, spm_percent: int = 80, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """key (and ``keep``), n units, form, prefix, middle, suffix (null if plain) and output of every whole text."""
    grammar = GRAMMARS[units] if isinstance(units, str) else units
    kept = [key, *(keep or [])]
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__k0").cast("string"), F.lit("")))
    rows = rows.select("*", pieces(F.col("text"), grammar).alias("units"), F.sha2(name, 256).alias("digest"))
    group = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    rows = rows.select("*", F.size("units").cast("long").alias("n"), *[group(i).alias(f"h{i + 1}") for i in range(4)])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("*", form.alias("form"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi"))
    cut = lambda first, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, size), ""))
    lo, hi = F.col("lo"), F.col("hi")
    rows = rows.select("*", cut(F.lit(1), lo).alias("prefix"), cut(lo + 1, hi - lo).alias("middle"), cut(hi + 1, F.size("units") - hi).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed output stands for. A text with a marker is plain, so the three markers split any other output."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sizes and hashes of what ``transform`` made."""
    return made.select(
        key, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
