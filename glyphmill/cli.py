"""``python -m glyphmill.cli``: ``export`` a model archive to a folder, ``verify`` a folder against the archive."""

from __future__ import annotations

import argparse

import numpy as np

from .sources import models

TEXTS = ("The river rose overnight.", "A list of parts, prices and dates.", "Numbers: 12, 345 and 6789!")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, folder in (("export", "--output-dir"), ("verify", "--export-dir")):
        sub = commands.add_parser(name)
        sub.add_argument("--checkpoint", required=True)
        sub.add_argument(folder, dest="folder", required=True)
    got = parser.parse_args(args)
    model = models.load(got.checkpoint)
    if got.command == "export":
        models.export(model, got.folder)
        print(f"wrote {got.folder}")
        return 0
    a, b = model(TEXTS), models.import_folder(got.folder)(TEXTS)
    same = a.shape == b.shape and np.allclose(a, b, rtol=1e-5, atol=1e-6)
    print("the vectors agree" if same else "the vectors differ")
    return int(not same)


if __name__ == "__main__":
    raise SystemExit(main())
