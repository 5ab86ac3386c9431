"""The registered queries of the panel operators, with their SQL."""

from quantpanel.catalog.features import FEATURES
from quantpanel.catalog.relations import RELATIONS

#: name -> (query, SQL or None)
CATALOG = FEATURES | RELATIONS
QUERIES = {name: query for name, (query, _) in CATALOG.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOG.items() if sql is not None}
