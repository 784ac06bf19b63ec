"""Plans and status reports as text, Markdown, JSON and YAML."""

from __future__ import annotations

import json

from ..model import Plan
from .cost import StepCost


#: What each class of change means for the data, dearest first.
EFFORT = {
    "blue-green": "built beside the old table, then swapped in",
    "rebuild": "filled anew from its inputs",
    "in-place": "kept, with columns added or cut",
    "free": "settings only, no data is read",
}


def _title(plan: Plan) -> str:
    return f"{plan.project}: first version" if not plan.from_version else f"{plan.project}: version {plan.from_version} to {plan.to_version}"


def _by_effort(plan: Plan):
    """(class, its changes) of the classes that occur, dearest first; any other class comes last."""
    changes = plan.summary.changes
    for cls in [*EFFORT, *sorted({c.cls for c in changes} - set(EFFORT))]:
        if own := [c for c in changes if c.cls == cls]:
            yield cls, own


def _size(cost: StepCost | None) -> str:
    if cost is None or cost.rows is None:
        return ""
    return f"about {cost.rows:,} rows, {cost.duration}"


def text(plan: Plan, costs: list[StepCost] | None = None) -> str:
    """What happens to which table, dearest first, then the steps in order, each with its size where that is known."""
    if plan.empty:
        return f"{plan.project} is as its files say; nothing to do.\n"
    out = [_title(plan)]
    for cls, changes in _by_effort(plan):
        out += ["", f"{cls}: {EFFORT.get(cls, 'as described')}"]
        out += [f"    {c.name}: {c.description}" for c in changes]
    out += ["", "in this order:"]
    digits = len(str(len(plan.steps)))
    for k, step in enumerate(plan.steps):
        size = _size(costs[k]) if costs and len(costs) == len(plan.steps) else ""
        out.append(f"  {k + 1:{digits}}. {step.describe()}" + (f" ({size})" if size else ""))
    return "\n".join(out) + "\n"


def markdown(plan: Plan) -> str:
    """The same for a pull request: a list for each class, the steps folded away."""
    if plan.empty:
        return f"### {plan.project}\n\nThe tables are as the files say.\n"
    out = [f"### {_title(plan)}"]
    for cls, changes in _by_effort(plan):
        out += ["", f"**{cls}** ({EFFORT.get(cls, 'as described')})", ""]
        out += [f"- `{c.name}` {c.description}" for c in changes]
    steps = [f"{k + 1}. {s.describe()}" for k, s in enumerate(plan.steps)]
    return "\n".join([*out, "", f"<details><summary>{len(steps)} steps</summary>", "", *steps, "", "</details>"]) + "\n"


def as_json(plan: Plan) -> str:
    return json.dumps(plan.to_json(), indent=2, ensure_ascii=False)


def yaml(plan: Plan) -> str:
    """The plan as YAML; strings are written as JSON strings, which YAML reads."""

    def lines(x, pad):
        if isinstance(x, dict) and x:
            for k, v in x.items():
                yield from entry(f"{pad}{k}:", v, pad + "  ")
        elif isinstance(x, list) and x:
            for v in x:
                first, *rest = lines(v, pad + "  ")
                yield pad + "- " + first.lstrip()
                yield from rest
        else:
            yield pad + json.dumps(x, ensure_ascii=False)

    def entry(head, v, pad):
        if isinstance(v, dict | list) and v:
            yield head
            yield from lines(v, pad)
        else:
            yield f"{head} {json.dumps(v, ensure_ascii=False)}"

    return "\n".join(lines(plan.to_json(), "")) + "\n"


def status(report: dict) -> str:
    version = f"version {report['version']}, applied {report.get('applied_at')} by {report.get('applied_by')}" if report["version"] else "never applied"
    waiting = f"{report['drift']} changes wait to be applied" if report["drift"] else "as its files say"
    return f"{report['project']}: {version}; nodes: {report['nodes']}; {waiting}\n"
