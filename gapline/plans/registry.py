"""All registered queries and their SQL oracles."""

from gapline.plans import population, timelines

QUERIES = {**population.QUERIES, **timelines.QUERIES}
SQL = {**population.SQL, **timelines.SQL}
