"""The ten operators as queries over whole tables, and the SQL that checks those SQL can express."""

from . import exact_dedup, hamming, secrets
from .exact_dedup import op5_exact_dedup
from .hamming import op9_hamming_top_k
from .language_id import op4_language_id
from .licenses import op6_license_scan
from .line_dedup import op8_fuzzy_line_dedup
from .mixing import op7_pivotal_mixing
from .near_dedup import op2_minhash_near_dedup
from .pieces import op1_sentencepiece
from .secrets import op10_secret_scan
from .toxicity import op3_toxicity

_ALL = (
    op1_sentencepiece,
    op2_minhash_near_dedup,
    op3_toxicity,
    op4_language_id,
    op5_exact_dedup,
    op6_license_scan,
    op7_pivotal_mixing,
    op8_fuzzy_line_dedup,
    op9_hamming_top_k,
    op10_secret_scan,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op9_hamming_top_k": hamming.ORACLE,
    "op10_secret_scan": secrets.oracle(),
}
