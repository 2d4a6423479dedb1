"""Training-data operators: ten DataFrame operators over text, pages, vectors and chats.

Each module holds one operator with its own general interface; ``queries`` and
``oracles`` register the thin ``opN_*`` queries.  Nothing else in the library
imports this subpackage.
"""
