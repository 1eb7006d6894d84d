"""Write the executed physical plans of selected queries (bucketed at-rest
layout) to a Markdown file: ``python tools/explain_all.py sf_dir out.md q1 q2 ...``."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terminus.catalog import QUERIES  # noqa: E402
from terminus.session import build_session  # noqa: E402
from terminus.sources.tables import CATALOG_PREFIX, materialize_bucketed  # noqa: E402


def main():
    sf_dir, out, names = sys.argv[1], sys.argv[2], sys.argv[3:]
    scratch = tempfile.mkdtemp(prefix="terminus-explain-", dir="/tmp")
    spark = build_session("local[8]", 16, extra={"spark.sql.warehouse.dir": os.path.join(scratch, "wh")})
    materialize_bucketed(spark, sf_dir, "terminus_explain", 16)
    src = CATALOG_PREFIX + "terminus_explain"
    with open(out, "w") as f:
        f.write(f"# Executed plans ({os.path.basename(sf_dir)}, bucketed at-rest layout, local[8])\n\n")
        f.write("Generated by `tools/explain_all.py`; AQE final plans after one run.\n")
        for n in names:
            df = QUERIES[n](spark, src)
            df.write.format("noop").mode("overwrite").save()
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            tree = plan.split("\n\n")[0].replace("== Physical Plan ==\n", "")
            f.write(f"\n## {n}\n\n```\n{tree}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
