"""Ids are those of the vocabulary as it is loaded."""

from __future__ import annotations

from array import array

from readloom.llm import tokens


def test_ids_equal_a_freshly_loaded_tokenizer():
    from tokenizers import Tokenizer

    fresh, ours = Tokenizer.from_file(tokens.default_paths()[0]), tokens.tokenizer(*tokens.default_paths())
    for text in ["", "plain words here", "one<|endoftext|>two", "<|endoftext|>", "Ελλάδα <|endoftext|> né", "<|endoftext| >", "  two  spaces\n\nné"]:
        assert array("I", ours.ids(text)).tolist() == fresh.encode(text, add_special_tokens=False).ids, text
