"""DataFrame -> DataFrame operators, one function per operator."""
