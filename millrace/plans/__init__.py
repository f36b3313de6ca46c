"""From text to DataFrames: lexer, parser, tree and binder."""
