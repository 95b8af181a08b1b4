"""Line-first quality rules.

Punctuation, navigation and boilerplate rules judge each line; lines that fail
are removed, and a document that loses more than `most_lost` of its words is
rejected.

Edge cases: a null or empty text has no word, fails the base rules and stays
null or empty; lines without a word are neither judged nor removed; repeated
rows are judged each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, map_batches, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
ENDS = tuple(".!?…:;,。！？؟।\"'”’»)]}")
SEPARATORS = frozenset(("|", "||", "»", "«", ">", ">>", "·", "•", "/", "::", "→", "-", "–"))
#: Phrases of boilerplate; fixed values.
BOILERPLATE = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|we use cookies|accept (?:all )?cookies|click here|read more|sign (?:in|up)|log ?in\b|subscribe (?:now|to)"
    r"|enable javascript|share (?:this|on)|follow us|lorem ipsum|licensed under|permission is hereby granted|©|\(c\) (?:19|20)\d\d|copyright (?:19|20)\d\d",
    re.I,
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict."""

    fewest_words: int = 4  #: a line without an end mark has more words, or is a heading or menu entry
    most_symbols: float = 0.25  #: symbol characters a word
    most_separators: float = 0.15  #: separators a word, two at least
    most_shouts: float = 0.3  #: words that end in two exclamation marks
    most_capitals: float = 0.7  #: capitals among cased letters, in a line of 20 letters or more
    most_one_word: float = 0.4  #: share of the commonest word, in a line of 10 words or more
    boilerplate_words: int = 25  #: a line with a boilerplate phrase falls if it has so many words at most
    most_lost: float = 0.5  #: share of a document's words


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that are found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key = ids[:n]
    for j in range(1, size):
        key = key * len(number) + ids[j : j + n]
        if j + 1 < size and len(number) > 1_000_000:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(size):
        covered[j : j + n] |= twice
    return int(covered.sum())


def failed_rule(line: str, rules: Rules = Rules()) -> str | None:
    """The first rule that a line fails: punctuation, navigation or boilerplate."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if sum(map(line.count, SYMBOLS)) > rules.most_symbols * n and n > 1:
        separators = sum(w in SEPARATORS for w in words)
        return "navigation" if separators > rules.most_separators * n else "punctuation"
    if "!!" in line and sum(w.endswith("!!") for w in words) > rules.most_shouts * n:
        return "punctuation"
    if n < rules.fewest_words and not line.rstrip().endswith(ENDS):
        return "punctuation"
    if (separators := sum(w in SEPARATORS for w in words)) >= 2 and separators > rules.most_separators * n:
        return "navigation"
    if n <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    if len(line) >= 20 and line.upper() == line != line.lower() and sum(map(str.isupper, line)) >= rules.most_capitals * sum(map(str.isalpha, line)):
        return "punctuation"
    if n >= 10 and len(set(words)) < 0.7 * n:
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        if max(counts.values()) > rules.most_one_word * n:
            return "boilerplate"
    return None


def clean(text: str, rules: Rules = Rules()) -> tuple[str, int, float]:
    """The lines that pass, how many fail, and the share of words lost."""
    kept, failed, words, lost = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(line.split())
        words += n
        if n and failed_rule(line, rules):
            failed += 1
            lost += n
        else:
            kept.append(line)
    return "\n".join(kept), failed, lost / words if words else 0.0


def judge(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", cleaned: bool = True) -> DataFrame:
    """key, base counts, base_failed, kept, n_failed_lines, lost_share, and the cleaned text on demand."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, outs = [], []
        for t in texts(batch):
            counts = base(t)
            out, failed, lost = clean(t, rules)
            bad = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            rows.append((*counts, bad, not bad and lost <= rules.most_lost, failed, lost))
            outs.append(out)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]
        columns = [batch.column("key")] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        if cleaned:
            columns.append(pa.array(outs, mask=batch.column("text").is_null().to_numpy(zero_copy_only=False)))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_share", *(["text"] if cleaned else [])]
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_share double" + (", text string" if cleaned else "")
    return map_batches(docs.selectExpr(f"`{key}` AS key", "text"), work, schema).withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass, all columns, their text without failing lines."""
    schema, name = docs.schema, fresh(docs, "text")[0]
    at = docs.columns.index("text") if name != "text" else -1
    if at < 0:
        raise ValueError("documents need a column text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        stays, outs = [], []
        for t in texts(batch):
            counts = base(t)
            out, _, lost = clean(t, rules)
            stays.append(counts[0] >= 50 and 100 * counts[4] <= 50 * counts[0] and lost <= rules.most_lost)
            outs.append(out)
        return batch.set_column(at, "text", pa.array(outs, batch.column(at).type)).filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, work, schema)
