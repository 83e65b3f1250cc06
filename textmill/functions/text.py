"""Native column expressions of the refiner: whole texts and single lines, inside whole-stage code generation.

They match the kernels but for code points whose class differs between Java's and Python's Unicode versions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill import semantics as S

J, lit = S.java, F.lit


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, lit(J(pattern)))


def removed(text: Column, *patterns: str) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, lit(J(p)), lit("")), patterns, text)


def stripped(text: Column) -> Column:
    """Python's strip()."""
    return F.btrim(text, lit(S.SPACES))


def let(value: Column, then) -> Column:
    """then(value), with value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def lines_of(text: Column) -> Column:
    """Python's splitlines(): no empty element after a last break; an empty text has no lines."""
    parts = F.split(text, S.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, lit(1), F.size(parts) - 1)).otherwise(parts)


def pollution(text: Column) -> dict[str, Column]:
    """Counts of what extraction leaves, and polluted."""
    counts = {
        "glyphs": count_of(text, S.GLYPH), "escaped_glyphs": count_of(text, S.GLYPH_ESCAPED), "privates": count_of(text, S.PRIVATE),
        "cids": count_of(text, S.CID), "replacements": count_of(text, S.REPLACEMENT), "entities": count_of(text, S.ENTITY),
    }
    marks = [counts[c] > 0 for c in list(counts)[:5]]
    return counts | {"polluted": reduce(lambda a, b: a | b, marks) | (counts["entities"] >= 3)}


def typographic(text: Column) -> Column:
    return F.translate(text, S.TYPE_FROM, S.TYPE_TO)


def private_bullets(text: Column) -> Column:
    return F.translate(text, S.PRIVATE_BULLETS, "•" * len(S.PRIVATE_BULLETS))


def guarded(text: Column, last: bool = False) -> Column:
    """Without private, control and zero-width characters; at the last also without replacement characters."""
    return removed(text, S.PRIVATE, S.CONTROL, S.ZERO_WIDTH, *([S.REPLACEMENT] if last else []))


def blank_gaps(text: Column) -> Column:
    return F.regexp_replace(text, lit("\n{3,}"), lit("\n\n"))


def whitespace_strict(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(text, lit("[ \t]+"), lit(" ")), lit(" ?\n ?"), lit("\n")))


def whitespace_safe(text: Column, keep_tables: bool = True) -> Column:
    def one(line: Column) -> Column:
        thin = F.regexp_replace(line, lit("[ \t]+"), lit(" "))
        return F.rtrim(F.when(lit(keep_tables) & is_table(line), line).otherwise(thin), lit(S.SPACES))

    return F.regexp_replace(F.array_join(F.transform(lines_of(text), one), "\n"), lit("^\n+|\n+$"), lit(""))


def bullets(line: Column, bullet: str = "•") -> Column:
    return F.regexp_replace(line, lit("(?U)" + S.BULLET_HEAD), lit(f"{bullet} "))


def profile(text: Column) -> Column:
    """clean_web, pdf_like, ocr_like or unknown, by counts only. Lines and texts are gone through once; what decides is computed once."""
    counts = pollution(text)
    signals = reduce(lambda a, b: a + b, [(counts[c] > 0).cast("int") for c in ("glyphs", "escaped_glyphs", "privates", "cids", "replacements")]) + (counts["entities"] >= 4).cast("int")
    marks = {
        "signals": signals, "hyphens": count_of(text, S.HYPHEN_BREAK), "runs": count_of(text, S.LONG_RUN), "broken": count_of(text, S.BROKEN_WORDS),
        "odd": F.regexp_count(text, lit("[\\p{Cc}\\p{Cf}\\p{Cs}\\p{Co}\\p{Cn}&&[^\\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x85]]")) / F.length(text),
    }

    def decided(length: Column) -> Column:
        n = F.size(length)
        share = lambda test: F.size(F.filter(length, test)) / n
        lines = {"n": n, "short": share(lambda v: v < 45), "single": share(lambda v: v == 1), "mean": F.aggregate(length, lit(0), lambda a, v: a + v) / n, "long": F.size(F.filter(length, lambda v: v >= 120))}
        return F.when(n < 8, "unknown").otherwise(let(F.struct(*(c.alias(k) for k, c in (lines | marks).items())), named))

    def named(f: Column) -> Column:
        web = (f["long"] >= 3) & (f["short"] <= 0.30) & (f["mean"] >= 85) & (f["signals"] == 0) & (f["hyphens"] == 0) & (f["odd"] < 0.0005) & (f["runs"] == 0) & (f["broken"] <= 1) & (f["single"] <= 0.02)
        pdf = (f["signals"] >= 2) | ((f["signals"] >= 1) & (f["hyphens"] >= 2))
        ocr = ((f["odd"] >= 0.0025) & (f["short"] >= 0.45)) | ((f["runs"] >= 3) & (f["short"] >= 0.40)) | ((f["broken"] >= 6) & (f["short"] >= 0.45)) | ((f["single"] >= 0.10) & (f["short"] >= 0.55))
        return F.when(web, "clean_web").when(pdf, "pdf_like").when(ocr, "ocr_like").otherwise("unknown")

    lengths = F.filter(F.transform(lines_of(text), lambda x: F.length(stripped(x))), lambda v: v > 0)
    return F.when(text.isNull() | (F.length(text) < 240), "unknown").otherwise(let(lengths, decided))


# single lines


def matches(line: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_like(line, lit(J(pattern, ignore_case)))


def tally(line: Column) -> tuple[Column, Column, Column, Column]:
    """Letters, digits, punctuation, spaces."""
    letters, digits = F.regexp_count(line, lit("\\p{L}")), F.regexp_count(line, lit("\\p{Nd}"))
    return letters, digits, F.regexp_count(line, lit("(?U)[^\\p{L}\\p{N}\\s]")), F.regexp_count(line, lit("(?U)\\s"))


def ratio(part: Column, line: Column) -> Column:
    return F.coalesce(F.try_divide(part, F.length(line)), lit(0.0))


def line_ratios(line: Column) -> dict[str, Column]:
    _, digits, punctuation, _ = tally(line)
    return {"caps_ratio": ratio(F.regexp_count(line, lit("\\p{Lu}")), line), "digit_ratio": ratio(digits, line), "punctuation_ratio": ratio(punctuation, line)}


def codepoints_joined(text: Column) -> Column:
    """U+ and at least four hexadecimal digits of each character, with spaces between. The UTF-32 of the whole text is cut, so the text is gone through a few times, however long."""
    apart = F.regexp_replace(F.hex(F.encode(text, "UTF-32")), lit("([0-9A-F]{8})"), lit("$1 "))
    return F.rtrim(F.regexp_replace(apart, lit("\\b0{1,4}"), lit("U+")))


def codepoints(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(codepoints_joined(text), " "))


def key_of(line: Column) -> Column:
    return F.regexp_replace(stripped(line), lit("[ \t]+"), lit(" "))


def is_boilerplate(line: Column) -> Column:
    return matches(stripped(line), S.BOILERPLATE, True)


def is_single(line: Column) -> Column:
    return F.regexp_like(stripped(line), lit("^[\\p{L}\\p{N}]$"))


def is_table(line: Column) -> Column:
    return F.regexp_like(line, lit("(?Us)^\\s*\\|.*\\|"))


def is_terminal(line: Column) -> Column:
    return F.regexp_like(line, lit("(?U)[.?!:;)\\]}\"']\\s*$"))


def starts_lower(line: Column) -> Column:
    return F.regexp_like(line, lit("^[^\\p{L}\\p{Nd}]*\\p{Ll}"))


def is_axis(line: Column) -> Column:
    bare = stripped(line)
    letters, digits, punctuation, spaces = tally(bare)
    n = F.length(bare)
    marks, part = ratio(digits + punctuation, bare), ratio(letters, bare)
    dense = ((spaces <= 1) & (n >= 36) & (marks >= 0.75) & (part <= 0.10)) | ((marks >= 0.85) & (part <= 0.08))
    return (n >= 12) & ~matches(bare, S.CAPTION, True) & ~matches(bare, S.UNITS, True) & (F.regexp_count(bare, lit("[A-Za-z]{3,}")) < 3) & dense


def is_layout_noise(line: Column) -> Column:
    """Looser than is_axis, with neither captions nor units spared; for reports."""
    bare = stripped(line)
    letters, digits, punctuation, spaces = tally(bare)
    n, marks = F.length(bare), ratio(digits + punctuation, bare)
    return is_single(line) | ((n >= 12) & (((spaces <= 1) & (n >= 30) & (marks >= 0.65)) | ((marks >= 0.75) & (ratio(letters, bare) <= 0.10))))


def is_navigation(line: Column) -> Column:
    columns = F.filter(F.split(stripped(line), "(?U)\\s{2,}"), lambda c: c != "")
    upper = lambda w: F.regexp_like(w, lit("[A-Z]")) & ~F.regexp_like(w, lit("[a-z]")) & (F.length(w) >= 3)
    return F.size(F.filter(columns, lambda c: F.exists(F.regexp_extract_all(c, lit("[A-Za-z0-9][A-Za-z0-9&/\\-]*"), 0), upper))) >= 3


def is_dotted(line: Column) -> Column:
    return matches(stripped(line), S.DOTTED)


def is_page_marker(line: Column) -> Column:
    return matches(stripped(line), S.PAGE_MARKER, True)


def is_separator(line: Column) -> Column:
    return matches(stripped(line), S.SEPARATOR)


def is_reference_head(line: Column) -> Column:
    return matches(stripped(line), S.REFERENCE_HEAD, True)


def is_reference_name(line: Column) -> Column:
    return F.lower(stripped(line)).isin(*S.REFERENCE_NAMES)


def is_reference_entry(line: Column) -> Column:
    return matches(stripped(line), S.REFERENCE_ENTRY)


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, "(?U)\\s+"), lambda w: w != "")


def is_title(line: Column) -> Column:
    bare = stripped(line)
    parts, n = words_of(bare), F.length(bare)
    letters, digits, _, _ = tally(bare)
    raised = F.size(F.filter(parts, lambda w: F.regexp_like(w, lit("^\\p{Lu}"))))
    shape = (F.size(parts) <= 8) & F.regexp_like(bare, lit("^\\P{L}*[\\p{L}&&\\P{Ll}]")) & (ratio(letters, bare) >= 0.55)
    shape &= (digits <= F.greatest(lit(3), F.floor(n / 12))) & ((F.size(parts) <= 3) | (raised / F.greatest(F.size(parts), lit(1)) >= 0.85))
    shape &= F.size(F.filter(parts, lambda w: F.length(w) >= 5)) <= 3
    may = n.between(3, 90) & ~bare.endswith("-") & ~is_terminal(bare) & ~is_table(bare) & ~matches(bare, S.CAPTION, True)
    return may & (is_reference_name(line) | shape)


def is_guarded(key: Column) -> Column:
    parts, n = words_of(key), F.length(key)
    letters, digits, _, _ = tally(key)
    plain = ~F.contains(key, lit("://")) & F.regexp_like(key, lit("^\\p{L}")) & ~F.regexp_like(key, lit(" (\\||-|--|/) "))
    return (
        F.when(matches(key, S.CAPTION, True) | matches(key, S.DOTTED), True).when(F.regexp_like(key, lit("[.?!;]$")), False).when((F.size(parts) < 1) | (F.size(parts) > 6), False)
        .when(n < 8, True).otherwise(plain & (letters > 0) & (ratio(letters, key) >= 0.65) & (digits <= 3) & (F.size(parts) <= 4))
    )
