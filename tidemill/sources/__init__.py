"""Sources: tables declared by options, files, sockets, generated rows, formats and lookups."""
