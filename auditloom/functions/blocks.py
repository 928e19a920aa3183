"""Nested blocks of source code, found in one pass with a stack of what is open.

Brackets of all kinds make blocks, and in Ruby ``do`` and the words that need an ``end``
as well. What stands in strings and comments makes none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_STRINGS = r"""\"(?:\\.|[^"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
_BRACES = re.compile(rf"(?P<skip>//[^\n]*|/\*.*?\*/|{_STRINGS})|(?P<open>[({{\[])|(?P<close>[)}}\]])", re.S)
_RUBY = re.compile(
    r"(?P<skip>\#[^\n]*|^=begin.*?^=end|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|:\w+)|(?P<open>[({\[]|\bdo\b|^[ \t]*(?:if|unless|case|while|until|begin|class|module|def|for)\b)|(?P<close>[)}\]]|\bend\b)",
    re.S | re.M,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: How far back what stands before an opening is looked for.
_HEAD = 400


@dataclass
class Block:
    """From the opening mark to behind the closing one (the end of the text if there is none); ``header`` is what stands before it on its line, from the last brace on, ``up`` the number of the block around it."""

    start: int
    end: int
    kind: str
    header: str
    up: int | None


class Blocks:
    def __init__(self, text: str, ruby: bool = False):
        self.text, self.all = text, []
        self.at: dict[int, int] = {}
        stack: list[int] = []
        brace = 0  # where the last brace ended
        for m in (_RUBY if ruby else _BRACES).finditer(text):
            if m["open"]:
                word = m["open"].strip()
                begin = m.end() - len(word)
                head = text[max(text.rfind("\n", 0, begin) + 1, brace, begin - _HEAD) : begin].strip()
                self.at[begin] = len(self.all)
                self.all.append(Block(begin, len(text), word if word in ("(", "[", "{", "do") else "word", head, stack[-1] if stack else None))
                stack.append(len(self.all) - 1)
            elif m["close"]:
                wanted = {")": "(", "]": "[", "}": "{"}.get(m["close"])
                fits = [i for i, b in enumerate(stack) if (self.all[b].kind == wanted if wanted else self.all[b].kind in ("do", "word"))]
                if fits:  # closes the innermost of its kind and all that is open within it
                    for b in stack[fits[-1] :]:
                        self.all[b].end = m.end()
                    del stack[fits[-1] :]
            if m[0] in "{}":
                brace = m.end()
        self._starts = [b.start for b in self.all]

    def inside(self, block: Block) -> str:
        closed = self.text[block.end - 1 : block.end] == _PAIRS.get(block.kind)
        return self.text[block.start + 1 : block.end - closed]

    def around(self, at: int) -> list[Block]:
        """The blocks that hold an offset, outermost first."""
        k = bisect_right(self._starts, at) - 1
        out: list[Block] = []
        i = k if k >= 0 else None
        while i is not None:
            if self.all[i].start < at < self.all[i].end:
                out.append(self.all[i])
            i = self.all[i].up
        return out[::-1]

    def outermost(self, within: Block, kind: str) -> list[Block]:
        """The blocks of a kind within a block that no other of that kind within it holds."""
        out: list[Block] = []
        for b in self.all[bisect_right(self._starts, within.start) :]:
            if b.start >= within.end:
                break
            if b.kind == kind and not (out and b.start < out[-1].end):
                out.append(b)
        return out
