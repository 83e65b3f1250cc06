"""Refinement of one text, where order and Python's Unicode tables matter: Arrow kernels call it a batch at a time.

The text is kept as lines with parallel lists of decisions; every stage marks lines as dropped, and later stages see
the survivors only.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np

from textmill import semantics as S
from textmill.config import RefineConfig, gate


def _any_of(*classes: str) -> re.Pattern[str]:
    """One class of several, which is searched faster than alternatives."""
    return re.compile(f"[{''.join(c[1:-1] for c in classes)}]")


GONE_EXTRACTED = _any_of(S.PRIVATE, S.ZERO_WIDTH, S.INVISIBLE, S.CONTROL, S.REPLACEMENT)
GONE_ALWAYS = _any_of(S.PRIVATE, S.CONTROL, S.ZERO_WIDTH)
GLYPH, GLYPH_ESCAPED, CID, ENTITY = (re.compile(p) for p in (S.GLYPH, S.GLYPH_ESCAPED, S.CID, S.ENTITY))
PRIVATE, REPLACEMENT = re.compile(S.PRIVATE), re.compile(S.REPLACEMENT)
DOTTED, BULLET_HEAD = re.compile(S.DOTTED), re.compile(S.BULLET_HEAD)
PAGE_MARKER = re.compile(S.PAGE_MARKER, re.I)
SEPARATOR = re.compile(S.SEPARATOR)
REFERENCE_HEAD, REFERENCE_ENTRY = re.compile(S.REFERENCE_HEAD, re.I), re.compile(S.REFERENCE_ENTRY)
BOILERPLATE, CAPTION, UNITS = (re.compile(p, re.I) for p in (S.BOILERPLATE, S.CAPTION, S.UNITS))
#: Blanks that aren't a space already.
BLANKS = re.compile("[ \t]{2,}|\t")
MARK_BETWEEN = re.compile(" ([|/]|--?) ")
LONG_WORD, TOC_WORD = re.compile("[A-Za-z]{3,}"), re.compile("[A-Za-z0-9][A-Za-z0-9&/\\-]*")
MARKED = "section_marker_inserted"
TERMINAL, REPLACEMENTS = frozenset(S.TERMINAL), S.REPLACEMENT[1:-1]
BLOCK_LINES, EDGE_LINES, LEAST_BLOCKS, LEAST_KEY, MOST_KEY, PRESENCE = 12, 2, 6, 12, 160, 0.8


# code points

#: Classes of code points, as bits.
SPACE, LETTER, WORD, ODD, PRIVATE_USE, REPLACED, GONE = (1 << i for i in range(7))
PASS = 1 << 16


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The classes of every code point, as re and str have them. Odd is what is neither printable nor white space."""
    every = "".join(map(chr, range(0x110000)))
    table = np.zeros(len(every), np.uint8)
    space, word, shown = (np.fromiter(map(test, every), bool, len(every)) for test in (str.isspace, str.isalnum, str.isprintable))
    for bit, those in ((SPACE, space), (WORD, word), (WORD, ord("_")), (ODD, ~shown & ~space)):
        table[those] |= bit
    for bit, pattern in ((LETTER, re.compile("[a-zA-Z]")), (PRIVATE_USE, PRIVATE), (REPLACED, REPLACEMENT), (GONE, GONE_ALWAYS)):
        table[[m.start() for m in pattern.finditer(every)]] |= bit
    return table


@lru_cache(maxsize=1)
def _latin_classes() -> bytes:
    return _classes()[:256].tobytes()


def _coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text, in a byte each if they all fit, and their classes."""
    try:
        latin = text.encode("latin-1")
        return np.frombuffer(latin, np.uint8), np.frombuffer(latin.translate(_latin_classes()), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table, kinds = _classes(), np.empty(len(codes), np.uint8)
    for lo in range(0, len(codes), PASS):  # take() has its indices in eight bytes each
        kinds[lo : lo + PASS] = table.take(codes[lo : lo + PASS])
    return codes, kinds


def _runs(codes: np.ndarray) -> int:
    """How often LONG_RUN is found: runs of five or more of a character that is no line feed."""
    same = codes[1:] == codes[:-1]
    three = same[1:] & same[:-1]
    if not three.any():
        return 0
    five = three[2:] & three[:-2]
    five &= codes[: len(five)] != 10
    return int(five[:1].sum()) + int(np.count_nonzero(five[1:] & ~five[:-1]))


def _broken(kinds: np.ndarray) -> int:
    """How often BROKEN_WORDS is found, one after another."""
    spaces = kinds & SPACE
    at = np.flatnonzero(spaces[1:-3] & spaces[3:-1])
    at = at[kinds[at] & kinds[at + 2] & kinds[at + 4] & LETTER != 0]
    n, end, last = 0, 0, len(kinds) - 5
    for i in at.tolist():
        if i >= end and not (i and kinds[i - 1] & WORD) and not (i < last and kinds[i + 5] & WORD):
            n, end = n + 1, i + 5
    return n


class Counts(NamedTuple):
    private: bool
    replaced: bool
    gone: bool
    odd: int
    runs: int
    broken: int


@lru_cache(maxsize=64)
def _counts(text: str) -> Counts:
    """What the code points of a text tell of it, in a few passes over arrays instead of a search per pattern."""
    codes, kinds = _coded(text)
    seen = int(np.bitwise_or.reduce(kinds))
    return Counts(bool(seen & PRIVATE_USE), bool(seen & REPLACED), bool(seen & GONE), int(np.count_nonzero(kinds & ODD)) if seen & ODD else 0, _runs(codes), _broken(kinds))


# whole texts


def polluted(text: str) -> bool:
    """Whether extraction left its marks: glyph names, private characters, cid codes, replacements, or three entities."""
    return any(_marks(text)) or ("&" in text and len(ENTITY.findall(text)) >= 3)


def _marks(text: str) -> list[bool]:
    """Which marks of extraction a text has. Patterns are only tried where the character is that they can't do without."""
    has = lambda c, p: c in text and p.search(text) is not None
    other = [] if text.isascii() else _counts(text)[:2]
    return [has("(cid:", CID), has("<", GLYPH), has("&", GLYPH_ESCAPED), *other]


def _mapped(text: str, table: dict[str, str]) -> str:
    """Characters replaced one to one, by none that is replaced itself; of long texts this is faster than translate()."""
    if not text.isascii():
        for old, new in table.items():
            text = text.replace(old, new)
    return text


def _cleared(body: str, text: str) -> str:
    """body without private, control and zero-width characters; text, which it was made of, has been counted."""
    gone = _counts(text).gone if body is text else (_coded(body)[1] & GONE).any()
    return GONE_ALWAYS.sub("", body) if gone else body


def without_artifacts(text: str) -> str:
    bare = CID.sub("", GLYPH.sub("", html.unescape(text)))
    mapped = _mapped(_mapped(bare, S.BULLETS), S.TYPOGRAPHIC)
    # removal is by class, each independent of the others, so one pass does
    return GONE_EXTRACTED.sub("", unicodedata.normalize("NFKC", mapped))


@lru_cache(maxsize=64)
def text_profile(text: str) -> str:
    """clean_web, pdf_like, ocr_like or unknown. Short texts (240 characters, 8 lines) are unknown."""
    if len(text) < 240:
        return "unknown"
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    n = len(lines)
    if n < 8:
        return "unknown"
    lengths = [len(x) for x in lines]
    short, single, mean = sum(v < 45 for v in lengths) / n, lengths.count(1) / n, sum(lengths) / n
    signals = sum(_marks(text)) + ("&" in text and len(ENTITY.findall(text)) >= 4)
    hyphens = len(re.findall(S.HYPHEN_BREAK, text))
    counts = _counts(text)
    odd, runs, broken = counts.odd / len(text), counts.runs, counts.broken
    tidy = signals == hyphens == runs == 0 and odd < 0.0005 and broken <= 1
    if tidy and sum(v >= 120 for v in lengths) >= 3 and short <= 0.3 and mean >= 85 and single <= 0.02:
        return "clean_web"
    if signals >= 2 or (signals and hyphens >= 2):
        return "pdf_like"
    noisy = [(odd >= 0.0025, 0.45), (runs >= 3, 0.40), (broken >= 6, 0.45), (single >= 0.10, 0.55)]
    return "ocr_like" if any(hit and short >= least for hit, least in noisy) else "unknown"


def _thinned(text: str, run: str, to: str) -> str:
    """Runs of run's one character are cut down to `to`, by halves, which is faster than a pattern."""
    while run in text:
        text = text.replace(run, to)
    return text


def thin(text: str) -> str:
    """Spaces and tabs in a row as one space."""
    return _thinned(text.replace("\t", " "), "  ", " ")


def whitespace(text: str, cfg: RefineConfig) -> str:
    if cfg.profile == "strict":
        return thin(text).replace(" \n", "\n").replace("\n ", "\n").strip()
    return "\n".join((x if cfg.keeps_tables and is_table(x) else thin(x)).rstrip() for x in text.splitlines()).strip("\n")


# single lines


def is_table(line: str) -> bool:
    return line.lstrip().startswith("|") and line.count("|") > 1


def is_terminal(line: str) -> bool:
    return line.rstrip()[-1:] in TERMINAL


def starts_lower(line: str) -> bool:
    first = line[:1]
    if not first.isalpha():
        first = next((c for c in line if c.isalpha() or c.isdigit()), "")
    return first.isalpha() and first.islower()


def is_single(line: str) -> bool:
    bare = line.strip()
    return len(bare) == 1 and bare.isalnum()


_ASCII = bytes(range(128))
_OUTSIDE = {test: bytes(c for c in _ASCII if not getattr(chr(c), test)()) for test in ("isalpha", "isdigit", "isspace", "isalnum")}


def _how_many(line: str, test: str) -> int:
    """Characters of a line that pass a test of str."""
    if line.isascii():
        return len(line.encode().translate(None, _OUTSIDE[test]))
    return sum(map(getattr(str, test), line))


def tally(line: str) -> tuple[int, int, int, int]:
    """Letters, digits, punctuation, spaces."""
    spaces = _how_many(line, "isspace")
    return _how_many(line, "isalpha"), _how_many(line, "isdigit"), len(line) - spaces - _how_many(line, "isalnum"), spaces


def is_axis(line: str) -> bool:
    """Numbers and marks of a plot's axis; captions, units and lines of three words are kept."""
    bare = line.strip()
    n = len(bare)
    # the cheapest tests come first: most lines have three words or are mostly letters
    if n < 12 or len(list(islice(LONG_WORD.finditer(bare), 3))) == 3 or _how_many(bare, "isalpha") / n > 0.10:
        return False
    letters, digits, punctuation, spaces = tally(bare)
    marks = (digits + punctuation) / n
    plotted = (spaces <= 1 and n >= 36 and marks >= 0.75) or (marks >= 0.85 and letters / n <= 0.08)
    return plotted and not CAPTION.search(bare) and not UNITS.search(bare)


def is_navigation(line: str) -> bool:
    """Three or more columns, three of them with an upper-case word."""
    bare = line.strip()
    if "  " not in bare and bare.isprintable():  # a space is the only white space that is printable
        return False
    words = bare.split()
    if len(words) < 3 or sum(map(len, words)) + len(words) - 1 == len(bare):  # no gap is wider than one
        return False
    columns = [c for c in re.split(r"\s{2,}", bare) if c]
    return len(columns) >= 3 and sum(any(w.isupper() and len(w) >= 3 for w in TOC_WORD.findall(c)) for c in columns) >= 3


def is_title(line: str) -> bool:
    """Looks like a section's title, for paragraphs and markers."""
    bare = line.strip()
    n = len(bare)
    if not 3 <= n <= 90:
        return False
    if bare[0].isalpha() and bare[0].islower():
        return bare.lower() in S.REFERENCE_NAMES
    if bare.endswith("-") or is_terminal(bare) or is_table(bare):
        return False
    if bare.lower() in S.REFERENCE_NAMES:
        return True
    parts = bare.split()
    first = next((c for c in bare if c.isalpha()), "")
    if len(parts) > 8 or not first or first.islower() or CAPTION.search(bare):
        return False
    letters, digits, _, _ = tally(bare)
    raised = sum(w[0].isupper() for w in parts) / len(parts)
    return letters / n >= 0.55 and digits <= max(3, n // 12) and (len(parts) <= 3 or raised >= 0.85) and sum(len(w) >= 5 for w in parts) <= 3


def is_guarded(key: str) -> bool:
    """Looks like a section's title, so it is no running header."""
    if CAPTION.search(key) or DOTTED.search(key):
        return True
    parts = key.split()
    if key[-1:] in (".", "?", "!", ";") or not 1 <= len(parts) <= 6:
        return False
    if len(key) < 8:
        return True
    if "://" in key or not parts[0][0].isalpha() or MARK_BETWEEN.search(key):
        return False
    letters, digits, _, _ = tally(key)
    return letters > 0 and letters / len(key) >= 0.65 and digits <= 3 and len(parts) <= 4


def ratios(line: str) -> tuple[float, float, float]:
    """Shares of capitals, digits and punctuation."""
    n = len(line)
    if not n:
        return 0.0, 0.0, 0.0
    _, digits, punctuation, _ = tally(line)
    return sum(c.isalpha() and c.isupper() for c in line) / n, digits / n, punctuation / n


# lines in order


def blocks(lines: list[str]) -> list[list[int]]:
    """Indices of the lines of each block of enough lines. A page marker opens a block; a separator or two blanks end one."""
    out: list[list[int]] = [[]]
    blank = 0
    for i, line in enumerate(lines):
        bare = line.strip()
        blank = 0 if bare else blank + 1
        if bare and PAGE_MARKER.match(bare):
            out.append([i])
        elif (bare and SEPARATOR.match(bare)) or blank >= 2:
            out.append([])
        elif bare or out[-1]:
            out[-1].append(i)
    return [b for b in out if sum(bool(lines[i].strip()) for i in b) >= BLOCK_LINES]


def running_lines(lines: list[str]) -> tuple[dict[int, tuple[int, float]], dict[int, int]]:
    """Headers and footers: index to (blocks that repeat it, share of blocks); and the block of each of their lines."""
    pages = blocks(lines)
    if len(pages) < 2:
        return {}, {}
    anywhere: dict[str, set[int]] = {}
    at_edge: dict[str, set[int]] = {}
    places: dict[str, set[int]] = {}
    of: dict[int, int] = {}
    for b, page in enumerate(pages):
        filled = [i for i in page if lines[i].strip()]
        keys = {i: BLANKS.sub(" ", lines[i].strip()) for i in filled}
        of.update(dict.fromkeys(filled, b))
        for key in keys.values():
            anywhere.setdefault(key, set()).add(b)
        for i in filled[:EDGE_LINES] + filled[-EDGE_LINES:]:
            key = keys[i]
            if LEAST_KEY <= len(key) <= MOST_KEY and not CAPTION.search(key) and not is_guarded(key) and not is_navigation(key):
                at_edge.setdefault(key, set()).add(b)
                places.setdefault(key, set()).add(i)
    found = {}
    for key, where in at_edge.items():
        share = len(where) / len(pages)
        if len(where) >= LEAST_BLOCKS and where == anywhere[key] and share >= PRESENCE:
            found.update(dict.fromkeys(places[key], (len(where), share)))
    return found, of


def noise_runs(lines: list[str]) -> set[int]:
    """Indices of runs of 8 single-character lines, or of 4 axis lines."""
    found: set[int] = set()
    kinds = ["single" if is_single(x) else "axis" if is_axis(x) else "" for x in lines]
    start = 0
    for i in range(1, len(kinds) + 1):
        if i == len(kinds) or kinds[i] != kinds[start]:
            if kinds[start] and i - start >= {"single": 8, "axis": 4}[kinds[start]]:
                found.update(range(start, i))
            start = i
    return found


def paragraphs(lines: list[str], keep_tables: bool, traced: bool = True) -> tuple[list[str], list[tuple[str, int, str, str]]]:
    """Lines with wrapped ones joined; events (category, index of the line before the break, before, after), which hold a
    growing paragraph again at each of its lines, only if they are traced."""
    out: list[str] = []
    events: list[tuple[str, int, str, str]] = []
    for i, line in enumerate(lines):
        if not i:
            out.append(line)
            continue
        last, tail, lower = out[-1], line.lstrip(), starts_lower(line)
        if not lower and not tail[:1].islower():
            out.append(line)
            continue
        head = last.rstrip()
        hyphen = head[-1:] == "-" and tail[:1].islower()
        kind = "hyphen_fix" if hyphen else "paragraph_merge" if lower and head[-1:] not in TERMINAL else ""
        # cheap tests come first; of a growing paragraph only the ends are looked at
        if not kind or last.startswith("## ") or tail.startswith("## ") or (keep_tables and (is_table(last) or is_table(line))) or is_title(line) or is_title(last):
            out.append(line)
            continue
        joined = head[:-1] + tail if hyphen else f"{head} {tail}"
        if traced:
            events.append((kind, i - 1, f"{last}\n{line}", joined))
        out[-1] = joined
    return out, events


def section_markers(lines: list[str]) -> tuple[list[str], list[tuple[str, int, str, str]]]:
    out: list[str] = []
    events = []
    for i, line in enumerate(lines):
        marked = f"## SECTION: {line.strip()}"
        wanted = is_title(line) and marked != (out[-1].strip() if out else "")
        if wanted:
            events.append((MARKED, i, line, marked))
        out += [marked, line] if wanted else [line]
    return out, events


def references_marked(lines: list[str]) -> tuple[list[str], list[tuple[str, int, str, str]]]:
    """Lines with ## REFERENCES before the first reference heading, or before the first entry of a tail that has five."""
    at = next((i for i, x in enumerate(lines) if x.strip().lower() in S.REFERENCE_NAMES), None)
    if at is None:
        entries = [i for i in range(max(0, len(lines) - 50), len(lines)) if REFERENCE_ENTRY.match(lines[i].strip())]
        at = entries[0] if len(entries) >= 5 else None
    if at is None or (at and lines[at - 1].strip() == "## REFERENCES"):
        return lines, []
    return [*lines[:at], "## REFERENCES", *lines[at:]], [(MARKED, at, lines[at], "## REFERENCES")]


# the whole refinement


@dataclass
class Decision:
    line_idx: int
    normalized_text: str
    raw_text: str
    page_idx: int = -1
    action: str = "keep"
    category: str = "other"
    confidence: float | None = None
    edge_hit_ratio: float | None = None
    repeat_count: int | None = None

    def drop(self, category: str, confidence: float) -> None:
        self.action, self.category, self.confidence = "drop", category, confidence


class Line:
    """A line whose decision isn't reported: it has only what later stages and counters look at."""

    action, category = "keep", "other"

    def __init__(self, text: str) -> None:
        self.normalized_text = text

    drop = Decision.drop


@dataclass
class Report:
    text_profile: str = "unknown"
    normalized_extracted: bool = False
    detail_enabled: bool = False
    input_len: int = 0
    output_len: int = 0
    removed_boilerplate_lines: int = 0
    removed_header_footer_lines: int = 0
    removed_layout_noise_lines: int = 0
    removed_references_lines: int = 0
    removed_repeated_lines: int = 0
    removed_toc_lines: int = 0
    decisions: list[Decision] = field(default_factory=list)


def decide(rows: list[Decision] | list[Line], cfg: RefineConfig, extracted: bool, profile: str, paged: bool = True) -> list[Decision] | list[Line]:
    """Marks what goes, stage by stage; returns what stays, its bullets rewritten. paged: whether lines get their block."""
    scanned = extracted and profile in ("pdf_like", "ocr_like")
    for number, block in enumerate(blocks([r.normalized_text for r in rows]) if paged else []):
        for i in block:
            rows[i].page_idx = number
    live = rows

    def sift(category: str, confidence: float, hits: set[int]) -> None:
        nonlocal live
        for i in hits:
            live[i].drop(category, confidence)
        live = [r for i, r in enumerate(live) if i not in hits]

    def where(test) -> set[int]:
        return {i for i, r in enumerate(live) if test(r.normalized_text)}

    if extracted:
        sift("boilerplate", 0.90, where(lambda x: BOILERPLATE.match(x.strip())))
    if gate(cfg.drop_layout_noise, scanned):
        sift("layout_noise", 0.82, noise_runs([r.normalized_text for r in live]))
    if extracted and profile != "clean_web":
        sift("toc_navigation", 0.88, where(is_navigation))
    if gate(cfg.drop_repeated_lines, scanned):
        found, of = running_lines([r.normalized_text for r in live])
        for i, b in of.items():
            live[i].page_idx = b
        for i, (count, share) in found.items():
            live[i].repeat_count, live[i].edge_hit_ratio = count, share
        sift("header_footer", 0.85, set(found))
    if gate(cfg.drop_references_section, scanned):
        heads = where(lambda x: REFERENCE_HEAD.match(x.strip()))
        if heads:
            first = min(heads)
            tail = set(range(first + 1, len(live)))
            live[first].drop("references_section", 0.92)
            for i in tail:
                live[i].drop("references_section", 0.90)
            live = live[:first]
    if cfg.drops_dotted_toc:
        sift("toc", 0.98, where(lambda x: "..." in x and DOTTED.search(x.strip())))
    for r in live:
        if head := BULLET_HEAD.match(r.normalized_text):
            r.normalized_text = f"{cfg.bullet} {r.normalized_text[head.end() :]}"
    return live


COUNTERS = {"toc": "removed_toc_lines", "layout_noise": "removed_layout_noise_lines", "header_footer": "removed_header_footer_lines", "boilerplate": "removed_boilerplate_lines", "references_section": "removed_references_lines"}


@lru_cache(maxsize=64)
def _body(text: str, extracted: bool, form: str) -> str:
    """The text before lines are looked at; several settings of a text share it."""
    body = without_artifacts(text) if extracted else _mapped(text, S.TYPOGRAPHIC)
    return _cleared(unicodedata.normalize(form, body), text)


def refine(text: str | None, cfg: RefineConfig, decisions: bool = False, detail: bool = False) -> tuple[str | None, Report]:
    """The refined text and its report. Null and empty texts stay as they are, with a report of zeros."""
    report = Report(detail_enabled=detail)
    if not text:
        return text, report
    report.input_len = len(text)
    report.text_profile = text_profile(text)
    scanned = report.text_profile in ("pdf_like", "ocr_like")
    extracted = cfg.normalize_extracted is True or (cfg.normalize_extracted == "auto" and (scanned or polluted(text)))
    report.normalized_extracted = extracted
    body = _body(text, extracted, cfg.normalize_form)
    lines = body.splitlines()
    if decisions:
        raw = text.splitlines()
        rows = [Decision(i, x, raw[i] if i < len(raw) else x) for i, x in enumerate(lines)]
    else:
        rows = [Line(x) for x in lines]
    kept = [r.normalized_text for r in decide(rows, cfg, extracted, report.text_profile, decisions)]
    for r in rows if len(kept) < len(rows) else []:
        if r.category in COUNTERS and r.action == "drop":
            setattr(report, COUNTERS[r.category], getattr(report, COUNTERS[r.category]) + 1)
    report.removed_repeated_lines = report.removed_header_footer_lines
    events: list[tuple[str, int, str, str]] = []
    if cfg.structure_mode != "off" and kept:
        kept, events = paragraphs(kept, cfg.keeps_tables, decisions)
        if cfg.structure_mode == "aggressive":
            for step in (section_markers, references_marked):
                kept, more = step(kept)
                events += more
    out = whitespace("\n".join(kept), cfg)
    if cfg.collapse_blank_lines:
        out = _thinned(out, "\n\n\n", "\n\n")
    if any(c in out for c in REPLACEMENTS):  # the other characters that go were taken out of the body
        out = REPLACEMENT.sub("", out)
    report.output_len = len(out)
    if decisions:
        pages = {r.line_idx: r.page_idx for r in rows}
        report.decisions = rows + [Decision(i, after, before, pages.get(i, -1), "keep", kind, 0.85) for kind, i, before, after in events]
    return out, report
