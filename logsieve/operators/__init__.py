"""DataFrame operators: parse, tokens, prep (index/split/chunk), model, flags,
explain, metrics, report, joins."""
