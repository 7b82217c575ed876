"""Sources and sinks: binary packs, files, configuration."""
