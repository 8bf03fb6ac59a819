"""Stream variant of the resumable load: new files only, finished files never repeated."""

import os
import tempfile

from sqlfold.streaming.load import stream_load
from conftest import SF


def test_stream_load_resumes(spark):
    root = tempfile.mkdtemp(prefix="sqlfold-stream-")
    src, out, ck = (os.path.join(root, p) for p in ("src", "out", "ck"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(3).collect()
    # files of one name in different folders are different files
    paths = [os.path.join(src, folder, name) for folder, name in (("a", "x.sql"), ("b", "x.sql"), ("b", "y.sql"))]

    def put(i):
        os.makedirs(os.path.dirname(paths[i]), exist_ok=True)
        with open(paths[i], "w", encoding="utf-8") as fh:
            fh.write(docs[i].text)

    def loaded():
        rows = spark.read.parquet(out).collect()
        return {p: [r.line for r in sorted((r for r in rows if r.file_id.endswith(p)), key=lambda r: r.line_no)] for p in paths}

    put(0)
    put(1)
    stream_load(spark, src, out, ck)
    want = [d.text.split("\n") for d in docs]
    assert loaded() == {paths[0]: want[0], paths[1]: want[1], paths[2]: []}
    put(2)
    stream_load(spark, src, out, ck)
    assert loaded() == dict(zip(paths, want))
