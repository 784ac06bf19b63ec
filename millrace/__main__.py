"""Commands over a project's folder: `spark-submit -m millrace plan shop` or `python -m millrace plan shop`.

Exit codes: 0 done, 1 changes were found and the flags ask to tell, 2 an error.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .errors import MillraceError
from .model import Plan
from .operators.project import Project
from .plans import render
from .sources.config import Config

FORMATS = {"text": render.text, "markdown": render.markdown, "json": render.as_json, "yaml": render.yaml}


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("millrace", description=__doc__.splitlines()[0])
    top.add_argument("--quiet", action="store_true", help="no output but errors")
    top.add_argument("--porcelain", action="store_true", help="JSON on one line instead of text")
    top.add_argument("--log-format", choices=("text", "json"), default="text", help="form of the events of a run")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, /, *flags: str, **valued) -> None:
        c = commands.add_parser(name)
        c.add_argument("directory", help="folder with millrace.toml and migrations/")
        c.add_argument("--target", help="a target of millrace.toml")
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for f, kind in valued.items():
            c.add_argument(f"--{f.replace('_', '-')}", type=kind)

    command("init")
    command("attach", name=str, path=str)
    command("plan", "fail-if-changed", "fail-on-drift", format=str, out=str, strategy=str)
    command("apply", "dry-run", "resume", "allow-rebuild", "yes", plan=str, strategy=str, force_skip=int, force_retry=int)
    command("diff", "fail-on-drift")
    command("status")
    command("audit", limit=int)
    command("rollback", "allow-rebuild", "accept-data-loss", to_version=int)
    command("refresh", name=str)
    command("validate", "strict")
    command("lint", "fail-on-warn")
    command("fmt", "check")
    command("unlock", "force")
    command("destroy", "dry-run", "confirm", "force-cascade")
    command("vacuum")
    return top


class Commands:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.args = args
        folder = Path(args.directory)
        settings = folder / "millrace.toml"
        config = Config.load(settings) if settings.exists() or args.command != "init" else Config(folder.resolve().name)
        target = config.target(args.target) if args.target else next(iter(config.targets.values()), None)
        root = target.warehouse if target and target.warehouse else f"{folder.resolve()}/.warehouse"
        self.project = Project(spark, config.project, root, config, emit=self.event)
        if args.command not in ("init", "attach", "unlock", "vacuum", "audit"):
            self.project.load(folder, target.vars if target else None)

    def event(self, e: dict) -> None:
        if not self.args.quiet:
            print(json.dumps(e) if self.args.log_format == "json" else " ".join(f"{k}={v}" for k, v in e.items()), file=sys.stderr)

    def say(self, value, text: str | None = None) -> None:
        if not self.args.quiet:
            print(json.dumps(value, default=str) if self.args.porcelain or text is None else text)

    def init(self) -> int:
        self.project.init(self.args.directory)
        return 0

    def attach(self) -> int:
        self.project.attach(self.args.name, self.args.path)
        return 0

    def plan(self) -> int:
        a, plan = self.args, self.project.plan(self.args.strategy)
        if (a.format or "text") not in FORMATS:
            raise MillraceError(f"no format '{a.format}'; known: {', '.join(FORMATS)}")
        if a.out:
            Path(a.out).write_text(json.dumps(plan.to_json()))
        self.say(plan.to_json(), FORMATS[a.format or "text"](plan))
        if a.fail_on_drift and not plan.empty:
            raise MillraceError("the live graph differs from the files")
        return int(a.fail_if_changed and not plan.empty)

    def apply(self) -> int:
        a, force = self.args, {}
        for k in ("force_skip", "force_retry"):
            if getattr(a, k) is not None:
                force[k] = getattr(a, k)
        if force and not a.yes:
            raise MillraceError("skipping or repeating a step needs --yes")
        plan = None
        if a.plan:
            plan = Plan.from_json(json.loads(Path(a.plan).read_text()))
            if plan.spec_hash != self.project.plan(a.strategy).spec_hash:
                raise MillraceError("the files changed since the plan was made")
        self.say(self.project.apply(plan, a.allow_rebuild, a.dry_run, a.resume, a.strategy, **force))
        return 0

    def diff(self) -> int:
        changed = self.project.diff().changes
        self.say([{"name": str(c.name), "kind": c.kind} for c in changed], "\n".join(f"{c.kind:10} {c.name}" for c in changed) or "no changes")
        return int(self.args.fail_on_drift and bool(changed))

    def status(self) -> int:
        report = self.project.status()
        self.say(report, render.status(report))
        return 0

    def audit(self) -> int:
        for r in self.project.audit(self.args.limit or 50).collect():
            self.say(r.asDict())
        return 0

    def rollback(self) -> int:
        self.say(self.project.rollback(self.args.to_version, self.args.allow_rebuild, self.args.accept_data_loss))
        return 0

    def refresh(self) -> int:
        self.say(self.project.refresh([self.args.name] if self.args.name else None))
        return 0

    def _diagnostics(self, found, strict: bool) -> int:
        for d in found:
            self.say(vars(d), d.render())
        bad = [d for d in found if d.severity == "error" or strict and d.severity == "warning"]
        if bad:
            raise MillraceError(f"{len(bad)} findings")
        return 0

    def validate(self) -> int:
        return self._diagnostics(self.project.validate(), self.args.strict)

    def lint(self) -> int:
        return self._diagnostics(self.project.lint(), self.args.fail_on_warn)

    def fmt(self) -> int:
        changed = self.project.format(self.args.check)
        self.say(changed, "\n".join(changed))
        if self.args.check and changed:
            raise MillraceError(f"{len(changed)} files are not in canonical form")
        return 0

    def unlock(self) -> int:
        self.say({"unlocked": self.project.unlock(self.args.force)})
        return 0

    def destroy(self) -> int:
        if not (self.args.dry_run or self.args.confirm):
            raise MillraceError("destroying a project needs --confirm")
        self.say(self.project.destroy(self.args.dry_run, self.args.force_cascade))
        return 0

    def vacuum(self) -> int:
        self.say(self.project.vacuum())
        return 0


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(words)
    try:
        return getattr(Commands(spark or SparkSession.builder.appName("millrace").getOrCreate(), args), args.command)()
    except (MillraceError, PySparkException, OSError, ValueError) as e:
        print(f"error[{getattr(e, 'code', 2)}]: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
