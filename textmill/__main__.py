"""python -m textmill [PRESET] [SETTING=VALUE ...] < text > refined text; a word of a setting is as in the configuration."""

from __future__ import annotations

import sys

from textmill.config import resolve
from textmill.functions.kernels import refine

WORDS = {"true": True, "false": False}


def main(args: list[str]) -> None:
    preset = args.pop(0) if args and "=" not in args[0] else "safe"
    settings = {name: WORDS.get(value, value) for name, value in (a.split("=", 1) for a in args)}
    text = sys.stdin.read()
    sys.stdout.write(text if preset == "raw" else refine(text, resolve(preset, **settings))[0])


if __name__ == "__main__":
    main(sys.argv[1:])
