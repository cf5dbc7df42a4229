"""The exported rule list (made by ``python -m velmira.llm.quality_training``)."""

# fmt: off
DEFAULT = "prose"
RULES = (
    ('table', (('cell_share', '>', 0.4764),)),
    ('list', (('symbol_share', '>', 0.031), ('symbol_share', '<=', 0.1636), ('item_share', '>', 0.5244))),
    ('list', (('symbol_share', '>', 0.0276), ('letter_share', '>', 0.9182), ('common_share', '<=', 0.2168))),
    ('list', (('tokens_per_line', '<=', 6.8467), ('tokens_per_line', '>', 2.089), ('letter_share', '>', 0.9874), ('distinct_rate', '>', 2.666))),
    ('list', (('tokens_per_line', '<=', 7.772), ('item_share', '>', 0.5096))),
    ('list', (('common_share', '<=', 0.0125), ('mean_word', '>', 4.8509), ('distinct_rate', '>', 2.1714), ('tokens_per_line', '<=', 7.5369))),
    ('list', (('separator_rate', '>', 0.2505), ('letter_share', '>', 0.9087))),
    ('junk', (('common_share', '<=', 0.2018),)),
    ('junk', (('distinct_rate', '<=', 3.1181),)),
    ('junk', (('mean_word', '<=', 4.3471), ('common_share', '<=', 0.3048))),
)
