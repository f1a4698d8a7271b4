"""Rule grammars: parsing, compiling, extraction."""
