"""From text to statements: lexer, nodes, parser, printer."""
