"""Encoders from a folder, with a tiny model whose file is put together here: it looks token vectors up in a table."""

import json
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer, models as kinds, normalizers, pre_tokenizers, processors

from driftwise import cli
from driftwise.operators import embed, models

WORDS = ["[PAD]", "[UNK]", "[CLS]", "one", "two", "three", "four"]
TABLE = np.random.default_rng(0).normal(size=(len(WORDS), 3)).astype(np.float32)


def field(number, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor_info(name, kind, dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def model_bytes():
    node = field(1, "table") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    values = b"".join(field(1, d) for d in TABLE.shape) + field(2, 1) + field(8, "table") + field(9, struct.pack(f"<{TABLE.size}f", *TABLE.ravel()))
    inputs = b"".join(field(11, tensor_info(n, 7, ["b", "t"])) for n in ("input_ids", "attention_mask"))
    graph = field(1, node) + field(2, "g") + field(5, values) + inputs + field(12, tensor_info("last_hidden_state", 1, ["b", "t", 3]))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("model")
    t = Tokenizer(kinds.WordLevel({w: k for k, w in enumerate(WORDS)}, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A", special_tokens=[("[CLS]", 2)])
    t.save(str(out / "tokenizer.json"))
    (out / "model.onnx").write_bytes(model_bytes())
    (out / "config.json").write_text(json.dumps({"max_position_embeddings": 48}))
    return str(out)


def unit(ids):
    v = TABLE[ids].astype(float).mean(0)
    return v / np.linalg.norm(v)


def test_encoder(folder):
    got = models.OnnxEncoder(folder).encode(["One two", "", None, "four other three three"])
    want = [unit([2, 3, 4]), unit([2]), unit([2]), unit([2, 6, 1, 5, 5])]
    assert np.allclose(got, want, atol=1e-6)
    assert models.OnnxEncoder(folder).encode([]).shape[0] == 0
    cut = models.OnnxEncoder(folder, most=2).encode(["two one one one"])
    assert np.allclose(cut, [unit([2, 4])], atol=1e-6)
    assert models.vector_width(folder) == 3


def test_limits_and_devices(folder, tmp_path):
    assert models.max_tokens(folder) == 48 and models.max_tokens(str(tmp_path)) == 512
    with pytest.raises(FileNotFoundError, match="model.onnx, tokenizer.json"):
        models.loaders(str(tmp_path))
    gpu = ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert models.providers("cpu", gpu) == gpu[1:] == models.providers("auto", gpu[1:])
    assert models.providers("auto", gpu) == [("CUDAExecutionProvider", {"device_id": 0}), gpu[1]]
    with pytest.raises(RuntimeError):
        models.providers("cuda", gpu[1:])
    with pytest.raises(ValueError):
        models.providers("tpu", gpu)


def test_pieces_are_the_text(folder):
    t = models.FileTokenizer(f"{folder}/tokenizer.json")
    text = "One  two,\nthree four! "
    pieces = t.tokens(text)
    assert "".join(pieces) == text and len(pieces) == len(t.ids(text)) == 6
    assert t.tokens("") == [] and t.text([]) == ""
    assert [w for w, _ in embed.windows(pieces, 2, t)] == ["One  two", ",\nthree", "four!"]


def test_documents(spark, folder):
    encoder, tokenizer, most = models.loaders(folder)
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "four"), ("c", None), ("d", "four")], "p_id string, text string")
    got = {r.p_id: r for r in embed.embedded(docs, encoder=encoder, tokenizer=tokenizer, limit=3).collect()}
    assert most == 48 and (got["a"].n_chunks, got["a"].n_tokens, got["c"].n_chunks) == (2, 4, 1)
    assert np.allclose(got["a"].embedding, (unit([2, 3, 4, 5]) + unit([2, 6])) / 2, atol=1e-6)
    assert np.allclose(got["b"].embedding, unit([2, 6]), atol=1e-6) and got["b"].embedding == got["d"].embedding
    assert embed.embedded(docs.limit(0), encoder=encoder, tokenizer=tokenizer).count() == 0


def test_command(spark, folder, tmp_path):
    rows = [("000001", 2001, "One", "two", "发明申请"), ("000001", 2002, "four", "", "发明申请")]
    spark.createDataFrame(rows, "stkcd string, p_year int, p_tt string, p_abs string, p_type string").selectExpr("*", "cast(p_year as string) as p_id").write.parquet(str(tmp_path / "raw"))
    args = cli.parser().parse_args(["embed", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "e"), "--model", folder, "--device", "cpu", "--model-name", "tiny"])
    assert cli.run(args, spark) == 0
    back = spark.read.parquet(str(tmp_path / "e" / "firm_year_tiny_embeddings.parquet")).orderBy("p_year").collect()
    assert [len(r.embedding) for r in back] == [3, 3] and np.allclose(back[1].embedding, unit([2, 6]), atol=1e-6)
