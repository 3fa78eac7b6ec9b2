"""Report text: section split, rejection, cleaning cascades and metric normalisation.

All functions map columns to columns with JVM expressions. Flags used throughout:
``i`` case-insensitive, ``d`` only ``\\n`` ends a line, ``U`` Unicode classes, ``m`` per line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import patterns as P

FLAGS = "(?idU)"
CASED = "(?dU)"
_MARK, _END = "\u0001", "\u0002"
#: Letters beside ASCII's own that match ASCII ones under ``FLAGS`` and that ``lower`` does not turn into them.
_ALIKE = (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Removes white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def folded(text: Column) -> Column:
    """Lower case, with the letters that patterns under ``FLAGS`` take for ASCII ones written as those."""
    for letter, plain in _ALIKE:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def _holds_any(low: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def cascade(text: Column, patterns: Iterable[str], replacement: str = " ", flags: str = FLAGS) -> Column:
    """Applies the patterns one after the other.

    A pattern with ``NEEDED_WORDS`` is only tried on texts that hold one of them. That is looked up in the first text
    once: where matches give way to a blank, no word arises that was not there.
    """
    patterns = list(patterns)

    def step(t: Column, p: str, low: Column | None = None) -> Column:
        replaced = lambda x: F.regexp_replace(x, flags + _anchored(p), replacement)
        if low is None or not P.NEEDED_WORDS.get(p):
            return replaced(t)
        return let(t, lambda x: F.when(_holds_any(low, P.NEEDED_WORDS[p]), replaced(x)).otherwise(x))

    if replacement != " " or not any(P.NEEDED_WORDS.get(p) for p in patterns):
        return reduce(step, patterns, text)
    both = F.struct(text.alias("t"), folded(text).alias("low"))
    return let(both, lambda b: reduce(lambda t, p: step(t, p, b["low"]), patterns, b["t"]))


def _anchored(pattern: str) -> str:
    """Lets a ``[^.]*?`` pattern start only where a sentence starts.

    Such a pattern, if it matches inside a sentence at all, matches from the
    sentence start, so the result is the same and long texts without stops are
    scanned once instead of once per character.
    """
    return r"(?:\A|(?<=\.)|\G)" + pattern if pattern.startswith("[^.]*?") else pattern


def matches_any(text: Column, patterns: Sequence[str], flags: str = FLAGS) -> Column:
    """True where one of the patterns is found; a single pass over the text."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, words: Sequence[str], whole_words: bool = False) -> Column:
    """True where the lower-cased text holds one of ``words`` (as a substring by default)."""
    low = F.lower(text)
    if whole_words:
        alternatives = "|".join(r"\Q" + w + r"\E" for w in words)
        return F.coalesce(low.rlike(rf"(?U)\b(?:{alternatives})\b"), F.lit(False))
    hits = [low.contains(w) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def sections(raw: Column, headers: Sequence[str] = P.SECTION_HEADERS) -> Column:
    """Struct (findings, impression) from line-start headers.

    A header's text runs to the next header and the last of equal headers counts.
    Impression falls back on conclusion, then recommendation. Without any header
    the whole text is findings.
    """
    header = rf"(?idUm)^\s*({'|'.join(headers)})\s*:?"
    parts = F.split(F.regexp_replace(raw, header, f"{_MARK}$1{_END}"), _MARK)
    found = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            F.upper(F.substring_index(p, _END, 1)).alias("name"),
            strip(F.substring(p, F.locate(_END, p) + 1, F.length(p))).alias("body"),
        ),
    )

    def last(secs: Column, name: str) -> Column:
        same = F.filter(secs, lambda s: s["name"] == name)
        return F.try_element_at(same, F.lit(-1))["body"]

    def pick(secs: Column) -> Column:
        impression = F.coalesce(
            last(secs, "IMPRESSION"), last(secs, "CONCLUSION"), last(secs, "RECOMMENDATION"), F.lit("")
        )
        split = F.struct(
            F.coalesce(last(secs, "FINDINGS"), F.lit("")).alias("findings"), impression.alias("impression")
        )
        return F.when(
            F.size(secs) == 0, F.struct(raw.alias("findings"), F.lit("").alias("impression"))
        ).otherwise(split)

    return let(found, pick)


def basic_clean(text: Column) -> Column:
    """Line breaks to blanks; ``[** **]`` masks, underscore and star runs removed; '' for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\n\r\t]", " ")
    t = F.regexp_replace(t, r"(?d)\[\*\*.*?\*\*\]", "")
    t = F.regexp_replace(t, "__+", " ")
    return strip(F.regexp_replace(t, r"\*\*+", " "))


def is_rejected_content(text: Column, patterns: Sequence[str] = P.TOXIC) -> Column:
    if tuple(patterns) != P.TOXIC:
        return matches_any(text, patterns)
    both = F.struct(text.alias("t"), folded(text).alias("low"))
    return let(both, lambda b: _holds_any(b["low"], P.TOXIC_WORDS) & matches_any(b["t"], patterns))


def remove_benign_noise(text: Column, patterns: Sequence[str] = P.BENIGN_NOISE) -> Column:
    return cascade(F.regexp_replace(text, CASED + P.CLOCK_TIME, ""), patterns)


def remove_view_phrases(text: Column, patterns: Sequence[str] = P.VIEW_PHRASES) -> Column:
    return cascade(text, patterns)


def repair_punctuation(text: Column, ghosts: Sequence[str] = P.GHOST_WORDS) -> Column:
    """Drops ghost words left at the start or after a colon, then tidies stops and blanks.

    A text with no ghost word at either place gets none by dropping others, so one test comes before all of them.
    """

    def dropped(t: Column) -> Column:
        for g in ghosts:
            t = F.regexp_replace(t, rf"{FLAGS}^{g}(?:,)?\s+", "")
            t = F.regexp_replace(t, rf"{FLAGS}:\s+{g}(?:,)?\s+", ": ")
        return t

    if tuple(ghosts) != P.GHOST_WORDS:
        text = dropped(text)
    else:
        haunted = rf"{FLAGS}(?:^|:\s+)(?:{'|'.join(ghosts)})(?:,)?\s+"
        text = let(text, lambda t: F.when(t.rlike(haunted), dropped(t)).otherwise(t))
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"(?U)\s+\.", ".")
    text = F.regexp_replace(text, r"\.{2,}", ".")
    return strip(F.regexp_replace(text, r"^[^a-zA-Z0-9]+", ""))


def second_pass_clean(text: Column, patterns: Sequence[str] = P.RESIDUAL_NOISE) -> Column:
    """Second cleaning pass; null and '' stay as they are."""
    t = squeeze(cascade(text, patterns))
    t = F.regexp_replace(t, r"\.{2,}", ".")
    t = F.regexp_replace(t, FLAGS + P.LEADING_CONJUNCTION, "")
    return F.when(text == "", text).otherwise(t)


def split_findings_impression(text: Column) -> Column:
    """Struct (findings, impression) by ``findings:`` / ``impression:`` anywhere in the text.

    The split only starts where a header stands directly before its colon; the
    search that follows also accepts blanks between them.
    """
    f_re, i_re = r"(?isU)\bfindings\s*:\s*", r"(?isU)\bimpression\s*:\s*"
    out = lambda f, i: F.struct(f.alias("findings"), i.alias("impression"))

    def header(t: Column, pattern: str, name: str) -> list[Column]:
        head = F.length(F.regexp_extract(t, f"({pattern})", 0))
        return [F.regexp_instr(t, F.lit(pattern)).alias(f"{name}_at"), head.alias(f"{name}_len")]

    def cut(h: Column) -> Column:
        t, f_at, i_at = h["t"], h["f_at"], h["i_at"]
        f_end, i_end, rest = f_at + h["f_len"], i_at + h["i_len"], F.length(t) + 1
        impression = F.when(i_at > 0, strip(F.substring(t, i_end, rest))).otherwise("")
        stop = F.when((i_at > 0) & (i_at > f_end), i_at).otherwise(rest)
        findings = F.when(f_at > 0, strip(F.substring(t, f_end, stop - f_end))).otherwise("")
        return out(findings, impression)

    def split(t: Column) -> Column:
        plain = ~F.lower(t).rlike("findings:|impression:")
        headers = F.struct(t.alias("t"), *header(t, f_re, "f"), *header(t, i_re, "i"))
        return F.when(plain, out(strip(t), F.lit(""))).otherwise(let(headers, cut))

    return let(F.coalesce(text, F.lit("")), split)


def dedup_findings_impression(findings: Column, impression: Column) -> Column:
    """One text of both; an impression that merely repeats the findings is dropped."""

    def norm(x: Column) -> Column:
        return squeeze(F.regexp_replace(F.lower(x), FLAGS + P.METRIC_HEADERS, " "))

    def repeats(n: Column) -> Column:
        longer = F.length(n["i"]) <= F.length(n["f"]) + 10
        return (n["f"] == n["i"]) | (n["i"].startswith(n["f"]) & longer)

    def join(s: Column) -> Column:
        f, i = s["f"], s["i"]
        same = let(F.struct(norm(f).alias("f"), norm(i).alias("i")), repeats)
        return F.when(f == "", i).when(i == "", f).when(same, f).otherwise(strip(F.concat_ws(" ", f, i)))

    both = F.struct(
        strip(F.coalesce(findings, F.lit(""))).alias("f"), strip(F.coalesce(impression, F.lit(""))).alias("i")
    )
    return let(both, join)


def merge_report(text: Column, dedup: bool = True) -> Column:
    """One text from a report given as plain text or as a JSON object with findings/impression."""

    def join(f: Column, i: Column) -> Column:
        if dedup:
            return dedup_findings_impression(f, i)
        return strip(F.concat_ws(" ", F.coalesce(f, F.lit("")), F.coalesce(i, F.lit(""))))

    def of_object(obj: Column) -> Column:
        return join(F.try_element_at(obj, F.lit("findings")), F.try_element_at(obj, F.lit("impression")))

    def of_text(t: Column) -> Column:
        merged = let(split_findings_impression(t), lambda c: join(c["findings"], c["impression"]))
        return let(merged, lambda m: F.when(m == "", strip(t)).otherwise(m))

    def merge(t: Column) -> Column:
        obj = F.when(t.rlike(r"^\s*\{"), F.from_json(t, "map<string,string>"))
        return let(obj, lambda o: F.when(o.isNotNull(), of_object(o)).otherwise(of_text(t)))

    return let(F.coalesce(text, F.lit("")), merge)


def metric_clean(text: Column, drop_bare_commands: bool = True) -> Column:
    """Lower case, headers off, blanks around ``.,;?!:``, markup off, white space squeezed."""
    t = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("<unk>"), F.lit("unk")))
    t = F.regexp_replace(t, FLAGS + P.METRIC_HEADERS, " ")
    t = F.regexp_replace(t, r"[\n\r\t]+", " ")
    t = F.regexp_replace(t, r"([.,;?!:])", " $1 ")
    return squeeze(_drop_markup(t, drop_bare_commands))


def clinical_clean(text: Column) -> Column:
    """As ``metric_clean`` but case and punctuation stay."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("<unk>"), F.lit("unk"))
    t = F.regexp_replace(t, FLAGS + P.METRIC_HEADERS, " ")
    return squeeze(F.regexp_replace(_drop_markup(t, True), r"[\n\r\t]+", " "))


def _drop_markup(t: Column, bare: bool) -> Column:
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\{[^}]*\}", "")
    if bare:
        t = F.regexp_replace(t, r"\\[a-zA-Z]+", "")
    return F.regexp_replace(t, r"[{}]+", "")


def display_clean(text: Column, markers: Sequence[str] = P.DISPLAY_MARKERS) -> Column:
    """Lines with a marker dropped, text after the last ``Report:`` kept, leading findings header cut."""
    marked = "|".join(r"\Q" + m + r"\E" for m in markers)
    lines = F.filter(F.split(strip(F.coalesce(text, F.lit(""))), "\n"), lambda line: ~line.rlike(marked))
    t = F.substring_index(F.concat_ws(" ", lines), "Report:", -1)

    def behead(x: Column) -> Column:
        colon = F.locate(":", x)
        head = F.upper(F.substring(x, 1, 8)) == "FINDINGS"
        return F.when(head & (colon > 0) & (colon <= 15), F.substring(x, colon + 1, F.length(x))).otherwise(x)

    return squeeze(let(t, behead))


def ascii_output(text: Column) -> Column:
    """Non-ASCII runs to blanks, turn marker off, cut to ``FINDINGS:``, header put in front."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]+", " ")
    t = strip(F.replace(t, F.lit("<end_of_turn>"), F.lit("")))
    at = F.locate("FINDINGS:", F.upper(t))
    cut = F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)
    return F.concat(F.lit("FINDINGS: "), squeeze(cut))


def clamp(text: Column, n: int) -> Column:
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, n)


def text_or_fallback(first: Column, second: Column, min_chars: int = 5) -> Column:
    """``first`` unless it is null or short, then ``second``; '' where that is null too."""
    short = F.length(F.coalesce(first, F.lit(""))) < min_chars
    return F.when(short, F.coalesce(second, F.lit(""))).otherwise(first)


def is_report_empty(text: Column, mode: str = "text") -> Column:
    """Empty test for plain text, or (``json``) for an object whose strings are all blank."""
    if mode == "text":
        return F.coalesce(strip(text) == "", F.lit(True))
    obj = F.from_json(text, "map<string,string>")
    blank = F.forall(F.map_values(obj), lambda v: F.coalesce(strip(v) == "", F.lit(True)))
    return F.coalesce(blank | ~text.rlike(r"^\s*\{"), F.lit(True))


def tokens(text: Column) -> Column:
    """White-space tokens; an empty array for blank text."""
    t = squeeze(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def ngrams(toks: Column, n: int) -> Column:
    """All ``n``-grams of a token array, joined by blanks."""
    if n == 1:
        return toks
    count = F.size(toks) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))


def rule_label(
    text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "Other", blank: str | None = None
) -> Column:
    """Label of the first rule one of whose words occurs in the lower-cased text.

    Null and blank texts get ``blank`` if one is given, else ``default``.
    """
    low = F.lower(text)
    out = F.when(F.coalesce(strip(text), F.lit("")) == "", default if blank is None else blank)
    for label, words in rules:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), label)
    return out.otherwise(default)
