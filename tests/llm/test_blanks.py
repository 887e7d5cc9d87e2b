"""Long runs of blanks in packing: in time, and with the ids of the library."""

import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parlance.llm import packing


def test_runs_of_blanks_take_linear_time():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = packing.byte_tokens(path), Tokenizer.from_file(path)
    own.encode("warm up")
    for text in ((" " * 50_000 + "x") * 4, (" " * 99_999 + "x") * 2, " " * 150_000 + "x y"):
        began = time.process_time()
        ids = np.frombuffer(own.encode(text), dtype="<u4")
        assert time.process_time() - began < 5
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
