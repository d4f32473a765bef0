"""Fixed word lists. Plain values, by language; no logic."""

# --- fixed values: languages -----------------------------------------------------------------

LANGUAGES = ("en", "ru", "de", "fr", "es", "pt", "zh")

LABEL_NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "inglês", "английский"),
    "ru": ("ru", "rus", "russian", "русский", "russe", "russisch", "ruso"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "немецкий"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "французский"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch", "испанский"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais"),
    "zh": ("zh", "zho", "chi", "chinese", "mandarin", "中文", "汉语", "chinesisch", "chinois"),
}

SUFFIX_LANGUAGES = {"ru": "ru", "su": "ru", "by": "ru", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "pt": "pt", "br": "pt", "cn": "zh", "tw": "zh", "uk": "en", "us": "en", "au": "en", "ie": "en"}

FUNCTION_WORDS = {
    "en": "the of and to in that is was for were with on as by at from this which be not are have has had an it its their more than but only after between into under over against without other no none when where while about".split(),
    "ru": "и в не на что с по как за от для при о из к а но это его их был была было были чтобы также между после до только хотя когда где уже или если во со об года году том".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch wurde wurden zwischen ohne".split(),
    "fr": "le la les de des du et à en un une dans que qui pour sur par au aux avec ne pas est sont été ont plus ce cette ces se sa son ses leur mais ou où comme entre après sans même bien selon alors il elle nous vous d l qu".split(),
    "es": "el la los las de del y en un una que por con para se su sus al es son fue fueron ha han más pero como entre después sin sobre lo le no ya este esta estos estas aunque mientras según también hasta cuando ni o muy".split(),
    "pt": "o a os as de do da dos das e em no na nos nas um uma que por com para se seu sua ao à é são foi foram não mais mas como entre depois sem sobre já este esta isso embora enquanto segundo também até quando nem ou muito pelo pela às".split(),
    "zh": "的 了 在 是 和 与 不 有 为 以 于 也 对 从 到 但 而 或 这 中 没有 尚未 根据 关于 之间 以及".split(),
}

# --- fixed values: page furniture ------------------------------------------------------------

MENU_WORDS = {
    "en": ("home", "contact", "archive", "data sets", "help", "newsletters", "subscribe", "search", "sign in", "log in", "about us", "about", "podcast", "topics", "editors", "privacy", "imprint", "menu", "login", "register", "sitemap", "press", "careers", "terms"),
    "fr": ("accueil", "contact", "archives", "données", "aide", "abonnement", "recherche", "connexion", "à propos", "rédaction", "thèmes", "mentions légales", "podcast", "newsletters"),
    "de": ("startseite", "kontakt", "archiv", "datensätze", "hilfe", "abo", "suche", "anmelden", "über uns", "redaktion", "themen", "impressum", "datenschutz", "podcast", "newsletter"),
    "es": ("inicio", "contacto", "archivo", "datos", "ayuda", "suscripción", "buscar", "entrar", "quiénes somos", "redacción", "temas", "privacidad", "podcast", "boletines"),
    "pt": ("início", "contato", "contacto", "arquivo", "dados", "ajuda", "assinatura", "buscar", "pesquisa", "entrar", "quem somos", "redação", "temas", "sobre nós"),
    "ru": ("главная", "контакты", "архив", "данные", "помощь", "подписка", "поиск", "войти", "о нас", "редакция", "темы", "подкаст", "рассылки", "реклама"),
    "zh": ("首页", "联系", "联系我们", "存档", "数据", "帮助", "订阅", "搜索", "登录", "关于我们", "编辑部", "主题"),
}

#: Patterns at the start of a line (lower case, digits as 0) that only furniture has.
FURNITURE_STARTS = {
    "en": (r"you are here\b", r"by [^|]{2,60}\| 0 min", r"written by .{2,60} for ", r"published 0", r"updated 0", r"advertisement$", r"advert$", r"sponsored (content|by)\b", r"article continues below", r"related reading\b", r"related( articles)?$", r"read (also|more)\b", r"you may also like", r"most read\b", r"more from ", r"follow .{2,60} for ", r"share this ", r"did you like this", r"save for later", r"print ·", r"get our ", r"subscribe to ", r"sign up ", r"enter your (e-?mail )?address", r"log in to ", r"comments? \(0\)", r"leave a comment", r"no part of this site", r"opinions are those", r"terms of use\b", r"privacy (notice|policy)\b", r"all rights reserved", r"we use cookies", r"your privacy matters", r"this (web)?site (stores|uses) ", r"javascript is needed", r"skip to "),
    "fr": (r"vous êtes ici", r"par [^|]{2,60}\| 0 min", r"(écrit|texte) par ", r"publié le 0", r"mis à jour", r"publicité$", r"contenu sponsorisé", r"la suite de l'article", r"à lire aussi", r"les plus lus", r"autres textes de ", r"suivez ", r"partage[rz] cette page", r"enregistrer ·", r"notre lettre", r"indiquez votre adresse|(saisissez|entrez|donnez|laissez) votre adresse", r"connectez-vous pour", r"commentaires \(0\)", r"aucune partie de ce site", r"mentions légales", r"tous droits réservés", r"nous utilisons des cookies", r"votre vie privée", r"ce site (dépose|utilise) ", r"javascript est nécessaire pour afficher les"),
    "de": (r"sie sind hier", r"von [^|]{2,60}\| 0 min", r"erschienen am 0", r"aktualisiert", r"anzeige$", r"werbung$", r"gesponsert", r"der artikel geht unten weiter", r"mehr zum thema", r"das könnte sie auch", r"meistgelesen", r"weitere beiträge von ", r"folgen sie .{2,60} für ", r"diesen beitrag teilen", r"merken ·", r"unser wochenbrief", r"(geben|tragen) sie (hier )?ihre adresse", r"zum kommentieren", r"kommentare \(0\)", r"impressum\b", r"alle rechte vorbehalten", r"wir verwenden cookies", r"ihre privatsphäre", r"diese seite (legt|verwendet|nutzt) ", r"für die kommentare wird javascript"),
    "es": (r"usted está aquí", r"por [^|]{2,60}\| 0 min", r"publicado el 0", r"actualizado", r"publicidad$", r"contenido patrocinado", r"el artículo sigue más abajo", r"lea también", r"lo más leído", r"más de [^ ]{3,}( [^ ]+){0,2}(:|$)", r"siga a ", r"comparta esta", r"guardar ·", r"nuestra carta", r"(escriba|deje|indique) su dirección", r"entre para comentar", r"comentarios \(0\)", r"aviso legal", r"todos los derechos", r"usamos cookies", r"su privacidad", r"este sitio (guarda|usa|utiliza) ", r"se necesita javascript para mostrar los"),
    "pt": (r"você está aqui", r"por [^|]{2,60}\| 0 min", r"publicado em 0", r"publicidade$", r"conteúdo patrocinado", r"o artigo continua", r"leia também", r"mais lidas?", r"mais de [^ ]{3,}( [^ ]+){0,2}(:|$)", r"siga ", r"compartilhe ", r"guardar ·", r"nossa carta", r"entre para comentar", r"comentários \(0\)", r"todos os direitos", r"usamos cookies", r"este site (guarda|usa|utiliza) "),
    "ru": (r"вы здесь", r"автор: [^|]{2,60}\| 0 мин", r"опубликовано 0", r"обновлено", r"реклама$", r"(материал|текст|контент) (нашего )?партн[её]ра", r"партн[её]рский материал", r"продолжение статьи ниже", r"читайте также", r"самое читаемое", r"другие материалы ", r"следите за |подпишитесь на ", r"поделиться ", r"сохранить ·", r"наше письмо", r"(укажите|введите|оставьте) (свой )?адрес", r"войдите, чтобы", r"комментарии \(0\)", r"правила ·", r"все права защищены", r"мы используем (файлы )?cookie", r"этот сайт (хранит|использует) ", r"для показа комментариев"),
    "zh": (r"您在这里|当前位置", r"广告$", r"相关阅读", r"版权所有", r"分享", r"评论（0）|评论 ?\(0\)"),
}

#: Patterns anywhere in a line that only furniture has.
FURNITURE_ANYWHERE = (
    r"^© ?0", r"all rights reserved\.?$",
    r"^[^.!?]{2,60} 0[.,]0[.,]0( ·|$)", r"^[^.]{1,40}\| 0 ?(min|мин)", r"(für tägliche neuigkeiten|chaque jour|cada día|каждый день)$", r"(in your inbox|einzutragen|, um .{2,60} zu erhalten|pour recevoir .{2,60}|para recibir .{2,60}|чтобы получать .{2,60})$", r"^(home|accueil|startseite|inicio|início|главная|首页) ?[/>»›] ",
)

#: Heads of lists of teasers: lines after them, up to other furniture, are teasers.
TEASER_HEADS = (r"related reading$", r"you may also like$", r"most read", r"more from [^:]*$", r"à lire aussi$", r"les plus lus", r"autres textes de [^:]*$", r"mehr zum thema$", r"das könnte sie auch interessieren$", r"meistgelesen", r"weitere beiträge von [^:]*$", r"lea también$", r"lo más leído", r"más de [^:]*$", r"leia também$", r"читайте также$", r"самое читаемое", r"другие материалы [^:]*$")

# --- fixed values: pages without content -----------------------------------------------------

#: Phrases (lower case) of error pages, notices, filler and placeholders, for weak labels only.
SHELL_PHRASES = {
    "en": ("page you asked for", "page not found", "has been moved or removed", "temporarily unavailable", "down for maintenance", "something went wrong", "try again", "access denied", "do not have permission", "too many requests", "session has expired", "bad gateway", "invalid answer", "establishing a connection to the database", "uncaught exception", "fatal error", "checking your browser", "confirm that you are a human", "enable javascript", "turn on scripts", "requires a modern browser", "switch scripts on", "loading content", "loading...", "incident", "quote the time of your visit", "back to the start page", "no longer available", "to be filled in", "goes here", "sample text", "layout testing", "your first post", "headline here", "main text of the article", "lorem ipsum", "text text text", "bla bla bla", "test test test", "undefined undefined", "null null", "nan nan", "[object object]", "#ref!", "tbd -", "todo: add"),
    "fr": ("est introuvable", "a été déplacée", "une erreur est survenue", "réessayer plus tard", "accès refusé", "n'avez pas le droit d'ouvrir", "indisponible pour maintenance", "activer javascript pour voir", "a besoin des scripts", "chargement en cours", "vérifions votre navigateur", "retournez à l'accueil", "lancez une recherche", "le problème persiste"),
    "de": ("die gesuchte seite", "schiefgelaufen", "später noch einmal", "zugriff verweigert", "dieses dokument nicht öffnen", "wegen wartung", "nicht erreichbar", "schalten sie javascript ein", "braucht aktive skripte", "inhalt wird geladen", "browser wird geprüft", "zur startseite", "wenn das problem bleibt"),
    "es": ("la página que busca", "no existe o fue movida", "algo salió mal", "vuelva a intentarlo", "acceso denegado", "no tiene permiso", "no disponible por mantenimiento", "active javascript", "necesita scripts", "cargando", "comprobando su navegador", "vuelva al inicio", "si el problema"),
    "pt": ("página não encontrada", "algo deu errado", "tente novamente", "acesso negado", "não tem permissão", "em manutenção", "ative o javascript", "carregando"),
    "ru": ("такой страницы нет", "была перемещена", "что-то пошло не так", "попробуйте позже", "доступ запрещён", "нет прав на открытие", "сервис недоступен", "технических работ", "включите javascript", "нужны скрипты", "загрузка", "проверяем ваш браузер", "вернитесь на главную", "воспользуйтесь поиском", "если ошибка повторяется"),
    "zh": ("页面不存在", "访问被拒绝", "请稍后再试", "加载中", "启用javascript"),
}

#: Unfilled template places.
PLACEHOLDER = r"\$\{[^}]{0,40}\}|\{\{[^}]{0,40}\}\}|<%=?[^%]{0,40}%>|%%[^%\s]{1,40}%%|\[\[[^\]]{1,40}\]\]|\{[A-Za-z_. ]{2,40}\}|#[A-Za-z_. ]{2,40}#|\[[A-Za-z_.]+(?: [a-z ]{2,20})?\d*\]|<[A-Za-z_.]+(?: [a-z0-9 ]{2,30})?>"
