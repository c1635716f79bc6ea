"""Texts that hold the literal text of an added token."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from findlake.llm import token_files


def test_added_tokens_have_the_ids_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), token_files.LibraryTokenizer(path)
    texts = ["<|endoftext|>", "one <|endoftext|> two", "", "x<|endoftext|>\n\n y's", "one two, three", "<|endoftext", "<|endo ftext|>", "<|endoftext|><|endoftext|>z"]
    found = [ids.tolist() for ids in ours.encode(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[0] == [50256]
