"""Fill-in-middle: documents rearranged around a cut-out middle, and restored from what was made."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dbgauge.llm.common import map_texts, read_table

SEED = 7
#: What precedes the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of documents that are rearranged, and of these the percent that begin with the suffix.
FIM_PERCENT, SPM_PERCENT = 100, 50

_FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class CutIndex:
    """Converts between code-point and byte places of one UTF-8 text.

    Only characters of more than one byte are recorded: their places, in bytes and in code points, and the excess bytes up to them. A place is
    found among them by ``searchsorted``; from there on it is arithmetic, and a text of ASCII alone has an empty index.
    """

    def __init__(self, data: np.ndarray):
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes_at]
        self.excess = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), out=self.excess[1:])
        self.chars_at = self.bytes_at - self.excess[:-1]
        self.n_chars = len(data) - int(self.excess[-1])

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        return chars + self.excess[np.searchsorted(self.chars_at, chars)]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """Byte places have to be at the edges of characters."""
        return places - self.excess[np.searchsorted(self.bytes_at, places)]


def _edges(data: np.ndarray, index: CutIndex, unit: str) -> tuple[int, np.ndarray | None]:
    """Number of units, and the byte edges of all of them (None for characters, whose edges are found one by one)."""
    if unit == "char":
        return index.n_chars, None
    ends = np.flatnonzero(data == 0x0A) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    return len(ends), np.concatenate([[0], ends])


def rearrange(
    text: str, draws: Sequence[int], unit: str = "line", sentinels: Sequence[str] = SENTINELS, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle, output. ``draws`` are four numbers: two cuts, whether, and in which order."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    index = CutIndex(data)
    n, edges = _edges(data, index, unit)
    if not raw or draws[2] % 100 >= fim_percent or any(mark in text for mark in sentinels):
        return n, "plain", None, None, text
    units = np.sort(np.array([draws[0] % (n + 1), draws[1] % (n + 1)], np.int64))
    cuts = index.to_bytes(units) if edges is None else edges[units]
    chars = units if edges is None else index.to_chars(cuts)
    low, high = cuts.tolist()
    prefix, middle, suffix = raw[:low], raw[low:high], raw[high:]
    p, s, m = (mark.encode() for mark in sentinels)
    spm = draws[3] % 100 < spm_percent
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), output.decode()


def _check_sentinels(sentinels: Sequence[str]) -> None:
    """Where a text and a sentinel meet, no other sentinel may come about, or restoring would be ambiguous."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b)) if k <= len(a)):
                raise ValueError(f"sentinel {b!r} can begin within {a!r}")


def fill_in_middle(
    documents: DataFrame, unit: str = "line", seed: int = SEED, sentinels: Sequence[str] = SENTINELS, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """Append n (units: ``line`` with its line break, or ``char``), form, prefix_chars, middle_chars and output.

    The cuts and the form follow from SHA-256 of the seed and doc_id, so reruns agree and rows that share an id are cut by the same draws. Forms: ``psm``
    prefix, suffix, middle; ``spm`` suffix, prefix, middle, each behind its sentinel; ``plain``, the text itself, where it is empty, holds
    a sentinel, or is not drawn; its prefix_chars and middle_chars are null. A null text is an empty one, a null id the empty word.
    Other columns stay, those named like a new one are replaced, and an empty table gives no row. One pass without a shuffle.
    """
    _check_sentinels(sentinels)
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")
    marks = tuple(sentinels)

    def make():
        def compute(cells: list[dict]) -> list[list]:
            made = []
            for cell in cells:
                draws = [int(cell["draw"][at : at + 8], 16) for at in range(0, 32, 8)]
                made.append(rearrange(cell["text"] or "", draws, unit, marks, fim_percent, spm_percent))
            return [list(column) for column in zip(*made)]

        return compute

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    input_ = documents.withColumn("__fim", F.struct("text", draw.alias("draw")))
    return map_texts(input_, "__fim", make, _FIELDS).drop("__fim")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made from."""
    p, s, m = (F.lit(mark) for mark in sentinels)
    part = F.split_part
    head, middle = part(output, m, F.lit(1)), part(output, m, F.lit(2))
    psm = F.concat(F.substr(part(head, s, F.lit(1)), F.lit(len(sentinels[0]) + 1)), middle, part(head, s, F.lit(2)))
    spm = F.concat(part(head, p, F.lit(2)), middle, F.substr(part(head, p, F.lit(1)), F.lit(len(sentinels[1]) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = F.sha2("output", 256).alias("output_sha256")
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed, back)


#: Lines as a list; what is left when their line breaks are put back is the text.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l,
    [CAST('0x' || substr(h, 8 * k + 1, 8) AS UBIGINT) FOR k IN [0, 1, 2, 3]] AS r
  FROM d
), c AS (
  SELECT *, len(l) AS n, least(r[1] % (len(l) + 1), r[2] % (len(l) + 1))::BIGINT AS a, greatest(r[1] % (len(l) + 1), r[2] % (len(l) + 1))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
      WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS y, array_to_string(l[b + 1:], '') AS z FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
