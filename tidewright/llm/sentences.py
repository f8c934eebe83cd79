"""Sentence boundaries across languages and scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.segmentation_rules import RULES, block_language

BLANK = re.compile(r"(?:\r\n|\n|\r|\u2028)[^\S\r\n\u2028]*(?:\r\n|\n|\r|\u2028)\s*|\u2029\s*|\f\s*")
#: A run of terminators with what closes on it; every one of them is put to the rules.
SPOT = re.compile(r"[.!?…。．！？।॥؟]+[\"'”’“»«)\]）］」』〉》]*")
QUOTED = re.compile(r"\"[^\"]+?\"|“[^”“]+”|„[^“”„]+[“”]|«[^»«]+»|»[^«»]+«|「[^」「]+」|『[^』『]+』")
CLAIM = re.compile(r"(?:청구항\s*)?(\d{1,4})\s?(?:[.．、]|\))(?!\d)|【請求項\s*([0-9０-９]+)】")
LINE_NUMBER = re.compile(r"(?<=[\n\r])[^\S\n\r]*(?=[\[［【]\d{4}[\]］】])")
NEXT_CLAIM = re.compile(r"(?<=[\n\r])[^\S\n\r]*((?:청구항\s*)?(\d{1,4})\s?[.．、](?!\d))|\s*(【請求項\s*[0-9０-９]+】)")
THAI_GAP = re.compile(r"(?<=[\u0e01-\u0e3a\u0e40-\u0e4e])\s+(?=[\u0e01-\u0e3a\u0e40-\u0e4e])")
LANGUAGES = {"eng": "en", "ger": "de", "jpn": "ja", "jp": "ja", "kr": "ko", "chi": "zh"}


def _breaks(block: str, hint: str) -> list[int]:
    """Positions in a block of running text where a sentence ends."""
    out = [m.start() for m in LINE_NUMBER.finditer(block)] if "\n" in block else []
    n = len(block)
    first = SPOT.search(block)
    thai = not block.isascii() and THAI_GAP.search(block)
    if not thai and (first is None or first.end() >= n):
        return out  # nothing to decide, so the language does not matter
    lang = block_language(block, hint)
    quoted = [(m.start(), m.end()) for m in QUOTED.finditer(block)] if not block.isascii() or '"' in block else []
    q, rules = 0, RULES[lang]
    for m in SPOT.finditer(block):
        at = m.end()
        if at >= n:
            break
        start = m.start()
        while q < len(quoted) and quoted[q][1] <= start:
            q += 1
        if q < len(quoted) and quoted[q][0] < start:
            close = quoted[q][1]
            if at < close:
                # inside a quotation; a closing mark after a space still closes on the terminator
                if block[at:close].strip() not in ("»", "”", "“", '"'):
                    continue
                at = close
                if at >= n:
                    break
            before = block[max(0, start - 40) : start] + block[start:at].replace(" ", "").replace("\u00a0", "").replace("\u202f", "")
        else:
            before = block[max(0, start - 40) : at]
        for rule in rules:
            if (rule.before is None or rule.before.search(before, max(0, len(before) - rule.reach))) and (rule.after is None or rule.after.match(block, at)):
                if rule.breaks:
                    out.append(at)
                break
    if lang == "th":
        out += [g.start() for g in THAI_GAP.finditer(block)]
    return sorted(out)


def _claims(block: str, first: int | None) -> list[int]:
    """Positions in a block of claims where the next claim starts: its number follows the one before, at the start of a line."""
    out, due = [], (first or 0) + 1
    for m in NEXT_CLAIM.finditer(block):
        if not m.start():
            continue
        if m.group(3):
            out.append(m.start(3))
        elif int(m.group(2)) == due:
            out.append(m.start(1))
            due += 1
    return out


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without white space at the ends. Null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    hint = (lang or "").lower()
    hint = LANGUAGES.get(hint, hint[:2])
    spans, at, n = [], 0, len(text)
    ends = [(m.start(), m.end()) for m in BLANK.finditer(text)] + [(n, n)]
    for end, following in ends:
        block = text[at:end]
        if block and not block.isspace():
            lead = len(block) - len(block.lstrip())
            claim = CLAIM.match(block, lead)
            if claim:
                cuts = _claims(block, int(claim.group(1)) if claim.group(1) else None)
            else:
                cuts = _breaks(block, hint)
            last = 0
            for cut in [*cuts, len(block)]:
                piece = block[last:cut]
                body = piece.strip()
                if body:
                    s = at + last + len(piece) - len(piece.lstrip())
                    spans.append((s, s + len(body)))
                last = cut
        at = following
    return spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, starts, ends = [], [], []
        texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, (text, lang) in enumerate(zip(texts, langs)):
            for s, e in sentence_spans(text, lang):
                keys.append(i)
                starts.append(s)
                ends.append(e)
        ids = batch.column(0).take(pa.array(keys, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])


def sentences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence of each text, offsets in code points, end exclusive.

    A blank line ends a sentence, a line break alone does not. A block that starts with a claim number is cut only where the next claim starts. In
    other blocks the rule cascade of the block's language (told from the block itself; `lang` only breaks ties) decides at every terminator, first
    match first; inside a quotation there are no boundaries. Texts are taken whole, each on its own, so nothing is shuffled; rows repeated whole give
    their sentences again. Null ids are kept."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    return rows.mapInArrow(_rows, "doc_id bigint, start_char int, end_char int")
