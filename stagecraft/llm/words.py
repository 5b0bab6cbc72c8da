"""Token ids of a BPE vocabulary whose words end in ``</w>``, at the speed of ``tiktoken``.

A text is cut at single blanks: no token crosses a blank and white space is dropped, so each chunk has ids of its own,
which are remembered.  A chunk of plain Latin text is cut into the tokenizer's words here, each word gets an end mark
of one byte, and ``tiktoken`` merges the bytes under the file's own ranks; any other chunk (control characters,
combining marks, other scripts) goes to ``tokenizers``.
"""

from __future__ import annotations

import json
import re

import numpy as np

from stagecraft.llm.util import Memo

END = "\x01"
SUFFIX = "</w>"
# Characters that the normaliser leaves as they are but for their case.
PLAIN = re.compile("[\t\n\r\x21-\x7e\xa1-ɏ]*")


class WordTokenBytes:
    """A text's token ids as little-endian 32-bit numbers, as an unchanged ``Tokenizer`` gives them.

    The file's added tokens are taken out of the text first, as ``tokenizers`` does by default.
    """

    def __init__(self, tokenizer_json: bytes, limit: int = 400_000) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        data = json.loads(tokenizer_json)
        split = data["pre_tokenizer"]["pretokenizers"][0]
        if data["model"]["end_of_word_suffix"] != SUFFIX or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a vocabulary of words with ends")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.added = [t["content"] for t in data["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token.removesuffix(SUFFIX)) + END.encode() * token.endswith(SUFFIX): i
                 for token, i in data["model"]["vocab"].items() if token not in self.added}
        self.merged = tiktoken.Encoding("own", pat_str=f"[^{END}]+{END}", special_tokens={}, mergeable_ranks=ranks).encode_ordinary
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.whole = Tokenizer.from_str(tokenizer_json.decode())
        self.known = Memo(self._chunk, limit)

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            return np.array(self.merged("".join([p + END for p in self.pieces(chunk.lower())])), "<u4").tobytes()
        return self._slow(chunk)

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._slow(text)
        return b"".join(map(self.known.__getitem__, text.split(" ")))
