"""All registered queries of the subpackage."""

from combforge.llm import chat, decontaminate, language, licenses, lines, mixing, neighbours, sharding, simhash, suffixes

MODULES = (licenses, language, chat, simhash, lines, neighbours, mixing, suffixes, decontaminate, sharding)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
