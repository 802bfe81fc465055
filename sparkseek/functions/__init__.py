"""sparkseek.functions"""
