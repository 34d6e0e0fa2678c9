"""Column expressions and the block-wise scan helpers."""
