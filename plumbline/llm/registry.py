"""All registered queries of this subpackage and the SQL they are compared with."""

from plumbline.llm.oracles import ORACLES as ORACLES
from plumbline.llm.queries import QUERIES as QUERIES
