"""Operations on training corpora: ten operators, each in a module of its own, and their registered queries.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library whole.
"""
