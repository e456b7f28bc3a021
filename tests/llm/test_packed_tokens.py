"""Operator 4: exact round trips."""

import io
import zlib

import numpy as np
import pytest

from tessera.llm import packed_tokens as op
from tessera.llm.common import shared_dir, table
from tessera.session import qualified
from tests.llm.util import documents, with_clashes

TEXTS = ["", " ", "a  b", "a\n b c", " x y ", "<|endoftext|> hi <|endoftext|>x y", "it's we'll don 't 's", "a 　b \x1c c\x85 d e",
         "x\t y z\r\n q", "a\nb\n", "\na b", "a\n\nb", "a\nb c.\n", "ab.\nCd, e!! f?\n\n", "word. Word, wörd; 12. a1.", "..", ". . ,"]


def test_words_give_the_ids_of_the_whole_text(spark):
    e = op.WordEncoder(op.tokenizer_path(), memo=50)
    texts = TEXTS + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for t in texts:
        want = e.tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want, t[:60]


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 20])
def test_shards(bits):
    rng = np.random.default_rng(bits)
    docs = [(i * 3 - 5, rng.integers(0, 1 << bits, n).astype(np.uint32)) for i, n in enumerate([0, 1, 7, 4096, 5000, 0, 13000, 1])]
    out = io.BytesIO()
    w = op.ShardWriter(out, bits, block=512)
    for d, ids in docs:
        w.add(d, ids)
    assert w.close() == sum(len(x) for _, x in docs)
    data = out.getvalue()
    r = op.ShardReader(lambda at, size: data[at:at + size], len(data))
    assert r.docs.tolist() == [d for d, _ in docs]
    assert all((r.document(i) == ids).all() for i, (_, ids) in enumerate(docs))
    flat = np.concatenate([x for _, x in docs])
    for a, b in ((0, len(flat)), (511, 513), (512, 512), (1000, 9999), (len(flat) - 1, len(flat))):
        assert (r.ids(a, b) == flat[a:b]).all()


def test_documents_in_order(spark):
    docs = with_clashes(documents(spark), "path", "shard", "start")
    folder = shared_dir(spark, "t")
    got = sorted(op.pack_documents(docs, folder, shard_ids=5000, block=256, partitions=3).collect(), key=lambda r: r.start)
    e, at = op.WordEncoder(op.tokenizer_path()), 0
    want = {}
    for d, t in ((r.doc_id, r.text) for r in docs.collect()):
        ids = np.array(e.tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(want.values())
    assert op.pack_documents(documents(spark, [])).count() == 0


def test_plain_paths_are_those_of_the_default_file_system(spark, tmp_path):
    """Spark and pyarrow must mean the same folder by ``spark.checkpoint.dir``."""
    assert shared_dir(spark, "x").startswith("file:/")
    fs, path = op.file_system(qualified(spark, str(tmp_path)))
    assert path == str(tmp_path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.elsewhere.link./shared", tmp_path.as_uri())
    try:
        conf.set("fs.defaultFS", "viewfs://elsewhere/")
        assert qualified(spark, "/shared/") == "viewfs://elsewhere/shared"
        assert op.file_system(qualified(spark, "file:///x"))[1] == "/x"
    finally:
        conf.set("fs.defaultFS", default)
