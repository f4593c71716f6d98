"""Plans of queries that unfold what an analysis found."""

import re

from docplan.queries import extraction


def test_no_second_copy_of_the_analysis_below_an_explode(spark):
    plan = extraction.link_dependencies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter [^\n]*size\([^\n]*> 0", plan)
