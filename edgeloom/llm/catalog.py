"""The registered queries of this package, and those that SQL can express as SQL."""

from __future__ import annotations

from .grid_join import SQL as GRID_JOIN_SQL
from .grid_join import op3_embedding_dedup
from .langid import op8_language_id
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import op7_line_dedup
from .mixing import op6_mixing
from .neighbours import op1_nearest_neighbours
from .packing import op11_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .pieces import op9_sentencepiece
from .shingle_join import op10_shingle_join
from .toxicity import op4_toxicity
from .urlfilter import op5_url_filter
from .vector_codes import SQL as VECTOR_CODES_SQL
from .vector_codes import op12_vector_codes
from .wrappers import op2_html_extraction

QUERIES = {q.__name__: q for q in (
    op1_nearest_neighbours, op2_html_extraction, op3_embedding_dedup, op4_toxicity, op5_url_filter, op6_mixing, op7_line_dedup, op8_language_id, op9_sentencepiece,
    op10_shingle_join, op11_best_fit_packing, op12_vector_codes, op13_periodic_runs,
)}
SQL = {"op3_embedding_dedup": GRID_JOIN_SQL, "op7_line_dedup": LINE_DEDUP_SQL, "op12_vector_codes": VECTOR_CODES_SQL}
