"""What SQL can say of the operators' results, against DuckDB."""

import pytest
from compare import connection, differences

from linkscope.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, Q.QUERIES, Q.ORACLE_SQL, name, SF, connection(SF)) == ""
