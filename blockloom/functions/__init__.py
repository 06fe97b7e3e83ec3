"""Part of blockloom; see the package README section."""
