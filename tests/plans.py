"""What a query's operators did, from the metrics of its plan."""

from __future__ import annotations


def most_rows(df) -> int:
    """The most rows that an operator of a collected ``df`` put out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            most = max(most, rows.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most
