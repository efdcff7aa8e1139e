"""Panel operators. Every one takes and returns DataFrames and is lazy unless it says otherwise."""
