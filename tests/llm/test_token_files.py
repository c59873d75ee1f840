import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from effectlens.llm import tokenfiles as K
from effectlens.llm.queries import op12_token_files, tokenizer_path
from tests.against import SF


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def listed(library, rows):
    """(id, start, n, crc) of rows in order."""
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_the_query_equals_the_library(spark, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in op12_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == listed(library, rows)


def test_odd_rows_and_no_rows(spark, odd, none, library, tmp_path):
    K.write_tokens(odd, f"{tmp_path}/odd", tokenizer_path(), 1)
    got = sorted(K.checksums(K.read_tokens(spark, f"{tmp_path}/odd")).collect(), key=lambda r: r.start)
    rows = odd.select("doc_id", "text").collect()
    assert [r.id for r in got] == sorted([r.doc_id for r in rows], key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    expected = listed(library, rows)
    assert sorted((r.id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or 0, n, c) for i, _, n, c in expected)
    K.write_tokens(none, f"{tmp_path}/none", tokenizer_path(), 1)
    assert K.checksums(K.read_tokens(spark, f"{tmp_path}/none")).count() == 0 and K.read_span(spark, f"{tmp_path}/none", 0, 9).count() == 0
    K.write_tokens(odd.selectExpr("cast(doc_id AS string) AS doc_id", "text"), f"{tmp_path}/named", tokenizer_path(), 1)
    assert K.read_tokens(spark, f"{tmp_path}/named").count() == 13


def test_files_are_as_laid_out(spark, tmp_path):
    rows = spark.range(3000).selectExpr("3000 - id AS doc_id", "array_join(transform(sequence(1, 300), x -> concat('w', (x * 7919 * (id + 1)) % 4001)), ' ') AS text")
    layout = K.Layout(row_group_bytes=256 << 10, page_bytes=16 << 10)
    K.write_tokens(rows, f"{tmp_path}/t", tokenizer_path(), 1, layout=layout)
    before, whole = -1, 0
    for f in sorted(glob.glob(f"{tmp_path}/t/tokens/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            by_name = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            assert group.total_byte_size < 2 * layout.row_group_bytes
            assert all(c.has_offset_index and c.has_column_index for n, c in by_name.items() if not n.startswith("ids"))
            assert by_name["ids.list.element"].has_offset_index and "RLE_DICTIONARY" in by_name["ids.list.element"].encodings
            assert all("DELTA_BINARY_PACKED" in by_name[c].encodings for c in K.DELTAS)
            low, high = by_name["id"].statistics.min, by_name["id"].statistics.max
            assert low > before
            before, whole = high, whole + 1
    assert whole > 4


def test_spans_read_a_part(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"word{i} and {k}" for k in range(i % 40))) for i in range(400)], "doc_id int, text string")
    K.write_tokens(docs, f"{tmp_path}/s", tokenizer_path(), 1)
    whole = sorted(K.read_tokens(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    flat = [t for r in whole for t in r.ids]
    for first, last in ((0, 5), (7, 8), (1000, 4000), (len(flat) - 3, len(flat) + 50), (0, len(flat)), (len(flat), len(flat) + 9)):
        got = sorted(K.read_span(spark, f"{tmp_path}/s", first, last).collect(), key=lambda r: r.start)
        assert [t for r in got for t in r.ids] == flat[first:last]
        assert not got or got[0].start == first
    plan = K.read_tokens(spark, f"{tmp_path}/s").select("id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
