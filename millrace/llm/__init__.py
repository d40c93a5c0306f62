"""Operators for preparing language-model training data.

The rest of the library never imports this subpackage; deleting the folder
leaves everything else working.
"""
