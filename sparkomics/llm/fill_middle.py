"""Fill-in-the-middle transformation: DuckDB SQL over the Arrow batches of mapInArrow.

A text of n code points is cut at two of its n + 1 places into prefix, middle and suffix. Each batch is registered with a
DuckDB connection of its task; `regexp_extract_all` cuts a text into blocks of BLOCK code points, and those blocks that hold
a cut into single ones, `list_slice` and `array_to_string` put the parts together, and `sha256` draws places and form. So a
text costs a few list entries a block, not one for each code point. Batches are registered in slices of at most SLICE bytes
of text, or one longer text alone; no text is shortened.

The draws depend on `seed` and doc_id alone: h1 to h4 are the first four groups of eight hex digits of the sha256 of
seed, a colon and the decimal doc_id. Prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), middle after the larger.

Nulls: a null text is empty; a null doc_id is drawn for as if it were the empty string. Empty texts, and texts that hold
`<P>`, `<S>` or `<M>`, stay plain, so that each output can be read back. Repeated rows give the same row each; ties don't
occur. An empty table gives no rows. Extra columns don't matter, whatever their names: only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import row_slices, text_bytes

BLOCK = 64
SLICE = 1 << 22

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

MACROS = f"""
CREATE TEMP MACRO units(t) AS regexp_extract_all(t, '(?s).');
CREATE TEMP MACRO joined(l) AS coalesce(array_to_string(l, ''), '');
CREATE TEMP MACRO piece(blocks, a, b) AS CASE WHEN a // {BLOCK} = b // {BLOCK}
  THEN joined(list_slice(units(blocks[a // {BLOCK} + 1]), a % {BLOCK} + 1, b % {BLOCK}))
  ELSE joined(list_slice(units(blocks[a // {BLOCK} + 1]), a % {BLOCK} + 1, {BLOCK}))
    || joined(list_slice(blocks, a // {BLOCK} + 2, b // {BLOCK})) || joined(list_slice(units(blocks[b // {BLOCK} + 1]), 1, b % {BLOCK})) END;
CREATE TEMP MACRO draw(hex, k) AS CAST('0x' || substring(hex, 8 * k - 7, 8) AS BIGINT);
CREATE TEMP MACRO read_back(output, form) AS CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN joined(list_select(string_split_regex(output, '<[PSM]>'), [2, 4, 3]))
  ELSE joined(list_select(string_split_regex(output, '<[PSM]>'), [3, 4, 2])) END
"""

FORM = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM batch
), placed AS (
  SELECT doc_id, text, n, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw(hex, 3) % 100 >= $percent
      THEN 'plain' WHEN draw(hex, 4) % 100 < $spm_percent THEN 'spm' ELSE 'psm' END AS form,
    least(draw(hex, 1) % (n + 1), draw(hex, 2) % (n + 1)) AS lo, greatest(draw(hex, 1) % (n + 1), draw(hex, 2) % (n + 1)) AS hi
  FROM drawn
), cut AS (
  SELECT *, CASE WHEN form = 'plain' THEN [] ELSE regexp_extract_all(text, '(?s).{1,BLOCK}') END AS blocks FROM placed
), parts AS (
  SELECT *, piece(blocks, 0, lo) AS prefix, piece(blocks, lo, hi) AS middle, piece(blocks, hi, n) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
FROM parts
""".replace("BLOCK", str(BLOCK))

DIGESTS = "SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(read_back(output, form)) AS restored_sha256 FROM batch"

RESTORED = "SELECT doc_id, form, read_back(output, form) AS text FROM batch"


def over_batches(df: DataFrame, sql: str, text: str, schema: str, parameters: dict | None = None) -> DataFrame:
    """The SQL over each slice of `batch`, whose column `text` is the long one; DuckDB runs in the tasks, one thread each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False}) as con:
            con.execute(MACROS)
            for batch in batches:
                _, offsets = text_bytes(batch.column(text))
                for at, end in row_slices(offsets, SLICE):
                    con.register("batch", pa.Table.from_batches([batch.slice(at, end - at)]))
                    yield from con.sql(sql, params=parameters).to_arrow_table().cast(arrow).to_batches()
                    con.unregister("batch")

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output. `percent` of the texts are cut,
    `spm_percent` of those have their suffix first."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return over_batches(rows, FORM, "text", SCHEMA, {"seed": str(seed), "percent": percent, "spm_percent": spm_percent})


def restored(formed: DataFrame) -> DataFrame:
    """doc_id, form, text: what `output` and `form` give back."""
    return over_batches(formed.select("doc_id", "form", "output"), RESTORED, "output", "doc_id long, form string, text string")


def digests(formed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return over_batches(formed, DIGESTS, "output", SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string"))
