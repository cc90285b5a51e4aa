"""A C and C++ front end in Python: lexer, conditional directives, structural scanner. It runs inside Arrow tasks."""
