"""What executed plans say of their scans."""


def files_read(df):
    """Files that the file scans of a DataFrame's last run read."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        number = node.metrics().get("numFiles")
        own = number.get().value() if number.isDefined() else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())
