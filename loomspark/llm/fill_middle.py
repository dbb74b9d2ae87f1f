"""Fill-in-the-middle training texts: a text is cut into units at two seeded places, and its parts are put in another order.

Scale: one pass over the documents without a shuffle. Python gets Arrow batches, which Spark bounds in bytes; the ends of a
text's units take four bytes each. Cuts follow from the id alone, so reruns and lost executors give the same rows.

Edge cases: a null text is empty; empty texts stay as they are. A null id seeds like an id without digits. Rows that are
repeated give a row each. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship

MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s)."


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends; what stands after the last match is a unit of its own."""
    ends = array("I", map(regex.Match.end, unit.finditer(text)))
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def seeds(salt: str, doc_id: str) -> list[int]:
    """The first four 8-digit groups of the digest of `salt:id`."""
    digest = hashlib.sha256(f"{salt}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(text: str, doc_id: str, unit: regex.Pattern, salt: str = "1", moved: int = 90, suffix_first: int = 20, marks=MARKS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text; moved and suffix_first are shares in hundredths."""
    ends = unit_ends(text, unit)
    n, (h1, h2, h3, h4) = len(ends), seeds(salt, doc_id)
    if not text or h3 % 100 >= moved or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def restore(output: str, form: str, marks=MARKS) -> str:
    """The text that an output was made of. The text holds no mark, so each stands once."""
    if form == "plain":
        return output
    p, s, m = (output.index(x) for x in marks)
    parts = {"p": output[p + len(marks[0]) : s if form == "psm" else m], "s": output[s + len(marks[1]) : m if form == "psm" else p], "m": output[m + len(marks[2]) :]}
    return parts["p"] + parts["m"] + parts["s"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, salt: str = "1", moved: int = 90, suffix_first: int = 20, marks=MARKS, texts: bool = True) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) of each row.

    unit: a pattern whose matches are the units, none of them empty; no mark may be part of another. texts: whether the outputs are returned too, not their digests only.
    """
    ship(docs.sparkSession)
    kinds = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output string" * texts
    names = [k.split()[0] for k in kinds.split(", ")]

    @F.pandas_udf(kinds)
    def run(ids: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        pattern, rows = regex.compile(unit), []
        for doc_id, text in zip(ids, bodies, strict=True):
            n, form, a, b, output = rearrange(text, doc_id, pattern, salt, moved, suffix_first, marks)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (output, restore(output, form, marks))]
            rows.append((n, form, a, b, *digests, *[output] * texts))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = run(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col), made.alias("made")).select(id_col, "made.*")


def query(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(read_table(spark, sf_dir, "documents"), texts=False)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS r FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m ELSE '<S>' || r || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""
