"""Shows what a schema says: ``python -m xylem schema.xsd [element ...]``, or validates: ``python -m xylem schema.xsd --validate file.xml ...``."""

from __future__ import annotations

import sys

from .plans.model import load


def main(argv: list[str]) -> int:
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if argv else 2
    model, told = load(argv[0])
    for d in told:
        print(f"{d.uri}:{d.line}: {d.severity}: {d.code}: {d.message}", file=sys.stderr)
    bad = any(d.is_error for d in told)
    if argv[1:2] == ["--validate"]:
        for path in argv[2:]:
            with open(path, "rb") as f:
                report = model.validate(f.read(), path)
            for d in report.diagnostics:
                print(f"{path}:{d.line}: {d.code}: {d.message}")
            print(f"{path}: {'valid' if report else 'not valid'}")
            bad |= not report
        return int(bad)
    for k, v in model.counts().items():
        print(f"{k}: {v}")
    for name in argv[1:] or list(model):
        print(model[name].tree())
    return int(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
