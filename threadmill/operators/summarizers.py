"""A summarizer that asks a command: a function ``(text, previous) -> answer`` for :func:`segments.summarize`, usable in any worker."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from threadmill.operators.segments import contract

MARK = "@@S1@@"


def command(variants: list[list[str]], seconds: int = 300, env: dict[str, str] | None = None) -> Callable[[str, str], str]:
    """Tries the command lines in turn, as with fewer and fewer flags, until one exits well with an answer that holds a marker.

    The request goes to standard input, never into arguments. No answer is the empty string: the item becomes an error.
    """
    def ask(text: str, previous: str) -> str:
        request = contract(previous, "segment") + f"{MARK}\n{text}\n"
        for args in variants:
            try:
                done = subprocess.run(args, input=request, capture_output=True, text=True, timeout=seconds, env={**os.environ, **(env or {})})
            except (OSError, subprocess.TimeoutExpired):
                continue
            if done.returncode == 0 and "@@S" in done.stdout:
                return done.stdout
        return ""

    return ask
