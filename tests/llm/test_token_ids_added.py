"""Added tokens of the file within texts, against the library at its default settings."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from callscope.llm import registry
from callscope.llm.token_ids import Encoder
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"
TEXTS = ["a <|endoftext|> b", f"{MARK} x", MARK, MARK * 3, f" {MARK}  \n{MARK}é", "<|endoftext", f"<|{MARK}|>", "plain words", "", f"日本 {MARK} ünï"]


def test_query_matches_markers(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, at, want = Tokenizer.from_file(JSON), 0, []
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in registry.op1_token_ids(spark, str(tmp_path)).collect()) == want
    assert Encoder(JSON, False).ids([TEXTS[0]])[0] == np.array([64, 220, 50256, 275], "<u4").tobytes()


@pytest.mark.parametrize("spelt_out", [False, True])
def test_other_kinds_of_added_tokens(tmp_path, spelt_out):
    file = json.load(open(JSON, encoding="utf-8"))
    plain = file["added_tokens"][0]
    for n, own in enumerate(({"content": "<pad>", "lstrip": True}, {"content": "word", "single_word": True}, {"content": "<x>", "special": False}, {"content": "<x><y>"}), 50257):
        file["added_tokens"].append(plain | {"id": n} | own)
    path = tmp_path / "own.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    library = Tokenizer.from_file(str(path))
    library.encode_special_tokens = spelt_out
    texts = [*TEXTS, "a  <pad> b", "word words sword word", "a<x>b <x><y><x>", f"<pad>{MARK} <x>"]
    got = [np.frombuffer(b, "<u4").tolist() for b in Encoder(str(path), spelt_out).ids(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
